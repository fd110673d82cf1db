r"""Pieces of SQL that several checks share: instants of texts, signals of claims, posts with their evidence.

DuckDB's expressions know no look-around, so words are marked first: \x01 before and \x02 behind each run of letters, digits and _.
"""

from __future__ import annotations

from claimscope.functions import claim_text as ct
from claimscope.operators.timestamps import ABBREVIATIONS, MONTHS

_ZONE = r"[ ]?(Z|z|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z0-9_+\-/]+\]|[A-Z]{2,5})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: pattern and the groups of year, month, day, hour, minute, second, fraction, half, zone (0: none).
_SHAPES = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{2}})\.(\d{{2}})\.(\d{{4}})(?: {_CLOCK}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_CLOCK}(?: ?([AaPp])[Mm])?{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ?)?(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{4}}) {_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
)


def instants(name: str, source: str, text: str, zone: str = "NULL") -> str:
    """CTEs that end in one of that name: the source's rows with ``us``, the instant of a text in microseconds or null."""
    cases = " ".join(
        f"WHEN regexp_matches(s, '{p}') THEN [{', '.join(f"regexp_extract(s, '{p}', {g})" if g else "''" for g in groups)}]" for p, groups in _SHAPES
    )
    offsets = ", ".join(f"'{k}': {int(v[0] + '1') * (int(v[1:3]) * 60 + int(v[4:]))}" for k, v in ABBREVIATIONS.items())
    months = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
    number = lambda i: f"CAST(coalesce(nullif(p[{i}], ''), '0') AS BIGINT)"
    month = f"CASE WHEN regexp_matches(p[2], '^[A-Z]') THEN list_position({months}, p[2]) ELSE {number(2)} END"
    return f"""{name}_s AS (SELECT *, trim({text}, ' ' || chr(9) || chr(10) || chr(13)) AS s, CAST({zone} AS VARCHAR) AS z0 FROM {source}),
    {name}_p AS (SELECT *, CASE {cases} END AS p FROM {name}_s),
    {name}_n AS (SELECT *, {number(4)} AS h0, {number(5)} AS mi, {number(6)} AS sec, lower(p[8]) AS half, p[9] AS zn,
      epoch_us(TRY_CAST(p[1] || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(p[3], 2, '0') AS DATE)) AS day_us FROM {name}_p),
    {name}_w AS (SELECT *, CASE WHEN mi < 60 AND sec < 60 THEN day_us + (CASE WHEN half = '' THEN CASE WHEN h0 < 24 THEN h0 END
        WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END * 3600 + mi * 60 + sec) * 1000000 + CAST(rpad(substr(p[7], 1, 6), 6, '0') AS BIGINT) END AS wall_us,
      CASE WHEN zn = '' THEN CASE WHEN z0 IN (SELECT name FROM pg_timezone_names()) THEN z0 ELSE 'UTC' END
        WHEN zn[1] = '[' THEN (SELECT any_value(name) FROM pg_timezone_names() WHERE name = zn[2:-2]) END AS tz,
      CASE WHEN regexp_matches(zn, '^[+-]') THEN rpad(replace(zn, ':', ''), 5, '0') END AS off FROM {name}_n),
    {name}_u AS (SELECT *, make_timestamp(wall_us) AS wall, timezone(coalesce(tz, 'UTC'), make_timestamp(wall_us)) AS late FROM {name}_w),
    {name} AS (SELECT * EXCLUDE (s, z0, p, h0, mi, sec, half, zn, day_us, wall_us, tz, off, wall, late),
      CASE WHEN regexp_matches(s, '^\\d{{1,20}}(\\.\\d{{1,9}})?$') THEN
        CASE WHEN length(split_part(s, '.', 1)) <= 11 THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000000 + CAST(rpad(substr(split_part(s, '.', 2), 1, 6), 6, '0') AS BIGINT)
             WHEN length(split_part(s, '.', 1)) <= 14 THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000 + CAST(rpad(substr(split_part(s, '.', 2), 1, 3), 3, '0') AS BIGINT)
             WHEN length(split_part(s, '.', 1)) <= 17 THEN CAST(split_part(s, '.', 1) AS BIGINT) ELSE TRY_CAST(split_part(s, '.', 1) AS BIGINT) // 1000 END
       WHEN tz IS NOT NULL THEN epoch_us(CASE WHEN timezone(tz, late - INTERVAL 1 HOUR) = wall THEN late - INTERVAL 1 HOUR
             WHEN timezone(tz, late - INTERVAL 30 MINUTE) = wall THEN late - INTERVAL 30 MINUTE ELSE late END)
       WHEN off IS NOT NULL AND CAST(off[2:3] AS INTEGER) <= 18 AND CAST(off[4:5] AS INTEGER) < 60 THEN wall_us - (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS BIGINT) * 60 + CAST(off[4:5] AS BIGINT)) * 60000000
       WHEN off IS NULL AND zn <> '' THEN wall_us - CAST(MAP {{{offsets}}}[upper(zn)] AS BIGINT) * 60000000 END AS us FROM {name}_u)"""


_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_QUANTITY = r"\x01\p{Nd}+(?:\x02[.,]+\x01\p{Nd}+)*(?:\x02[.,]+\x01[kK]\x02|\x02[.,]+\x01|[kK]?\x02)"
_ENTITY = rf"\x01[A-Z][a-z]{{2,}}\x02(?:{_WS}+\x01[A-Z][a-z]{{2,}}\x02)*"
_MODAL = r"(?i)\x01(?:definitely|confirmed|proved|certainly|sure|guaranteed|reported|reportedly|according\x02 \x01to)\x02"
_DATE = r"\x01\p{Nd}{4}\x02-\x01\p{Nd}{2}\x02-\x01\p{Nd}{2}\x02"
_STOP = "[" + ", ".join(f"'{w}'" for w in ct.ENTITY_STOPLIST) + "]"


def marked(text: str) -> str:
    return rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"


def _all(text: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({marked(text)}, '{pattern}'), lambda x: replace(replace(x, chr(1), ''), chr(2), ''))"


def dates(text: str) -> str:
    return _all(text, _DATE)


def modals(text: str) -> str:
    return _all(text, _MODAL)


def entities(text: str) -> str:
    return f"list_filter({_all(text, _ENTITY)}, lambda e: contains(e, ' ') OR NOT list_contains({_STOP}, e))"


def quantities(text: str) -> str:
    links = rf"flatten(list_transform(regexp_extract_all({text}, 'https?://\S+'), lambda u: regexp_extract_all(u, '\d+')))"
    return rf"list_filter({_all(text, _QUANTITY)}, lambda q: NOT regexp_matches(q, '^(19|20)\d{{2}}$') AND NOT list_contains({links}, q))"


def spans(text: str) -> str:
    parts = rf"string_split(regexp_replace({text}, '([.?!]){_WS}+', '\1' || chr(3), 'g'), chr(3))"
    kept = f"list_filter({parts}, lambda s: regexp_matches({marked('s')}, '{_QUANTITY}') OR regexp_matches({marked('s')}, '{_MODAL}'))"
    return f"list_transform({kept}, lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g'))"


def prepositions(text: str) -> str:
    """preposition:object of each place."""
    pattern = rf"(?i)\x01({'|'.join(ct.PREPOSITIONS)})\x02{_WS}+((?:[\x01\x02]*[A-Za-z0-9_\-]){{2,}})"
    pairs = ", ".join(f"regexp_extract_all({marked(text)}, '{pattern}', {g})" for g in (1, 2))
    return f"list_transform(list_zip({pairs}), lambda z: lower(z[1]) || ':' || lower(replace(replace(z[2], chr(1), ''), chr(2), '')))"


def complex_enough(text: str) -> str:
    clean = f"regexp_replace({text}, '{ct.EMOJI.replace(chr(92) * 2, chr(92))}', '', 'g')"
    return f"(trim({text}) <> '' AND (len(regexp_extract_all({marked(clean)}, '\\x01[a-zA-Z]{{3,}}\\x02')) >= 3 OR len({entities(text)}) > 0))"


def attributed(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{a}')" for a in ct.ATTRIBUTION) + ")"


_FP = r"lower(regexp_replace(claim_fingerprint, '[^\p{L}\p{N}]', '', 'g'))"
#: Posts with the evidence of their latest claim, as ``pp``; the claims of stored posts with their text, as ``hh``.
POSTS = rf"""{instants("pz", "(SELECT * FROM posts WHERE uri IS NOT NULL)", "created_at", "client_zone")},
 p1 AS (SELECT * FROM pz QUALIFY row_number() OVER (PARTITION BY uri ORDER BY seq) = 1),
 c1 AS (SELECT post_uri, {_FP} AS fp, evidence_hash, evidence_class FROM claim_history WHERE post_uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_uri ORDER BY seq DESC) = 1),
 p2 AS (SELECT p1.uri, seq, author_did AS author, coalesce(reply_root_uri, p1.uri) AS root, us, coalesce(text, '') AS text, coalesce(c1.fp, '') AS fp, coalesce(evidence_hash, '') AS hash,
   len(regexp_extract_all(coalesce(text, ''), 'https?://\S+')) > 0 OR coalesce(evidence_class IN ('link', 'mixed'), false) AS links, coalesce(evidence_class IN ('embed', 'mixed'), false) AS embeds,
   coalesce(evidence_class IN ('facet', 'mixed'), false) AS facets FROM p1 LEFT JOIN c1 ON c1.post_uri = p1.uri),
 pp AS (SELECT *, links OR embeds AS evidence, trim(replace(lower(text), chr(10), ' ')) AS t, {attributed("text")} AS attributed,
   list_concat(list_concat(list_transform({dates("text")}, lambda x: 'd' || x), list_transform({quantities("text")}, lambda x: 'q' || x)), list_transform({entities("text")}, lambda x: 'e' || x)) AS tokens,
   least(1.0, len({modals("text")}) / 3.0) AS sure FROM p2),
 {instants("hz", "(SELECT * FROM claim_history WHERE post_uri IS NOT NULL AND author_did IS NOT NULL AND claim_fingerprint IS NOT NULL)", "created_at")},
 hh AS (SELECT hz.author_did AS author, {_FP} AS fp, hz.us, hz.post_uri AS uri, coalesce(evidence_hash, '') AS hash, pp.t, pp.attributed, pp.tokens, pp.sure
   FROM hz JOIN pp ON pp.uri = hz.post_uri WHERE hz.us IS NOT NULL)"""
COMPARABLE = r"(contains(q.t, p.t) OR contains(p.t, q.t) OR len(list_filter(string_split_regex(q.t, '\s+'), lambda w: length(w) > 4 AND contains(p.t, w))) > 0)"
_LATEST = "arg_max(q.uri, (coalesce(q.us, -9000000000000000000), q.uri))"
REPEATED = f"""rr AS (SELECT p.uri, {_LATEST} AS prior FROM pp p JOIN pp q ON p.root = q.root AND p.author = q.author AND p.evidence = q.evidence AND p.uri <> q.uri AND {COMPARABLE} GROUP BY p.uri)"""
LAUNDERED = f"""l1 AS (SELECT p.uri, {_LATEST} AS prior FROM pp p JOIN pp q ON p.root = q.root AND p.author = q.author AND NOT p.attributed AND q.attributed AND ({COMPARABLE} OR list_has_any(p.tokens, q.tokens)) GROUP BY p.uri),
 l2 AS (SELECT p.uri, {_LATEST} AS prior FROM pp p JOIN hh q ON p.author = q.author AND p.fp = q.fp AND q.us < p.us AND NOT p.attributed AND q.attributed AND ({COMPARABLE} OR list_has_any(p.tokens, q.tokens))
   WHERE p.uri NOT IN (SELECT uri FROM l1) GROUP BY p.uri), ll AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""
SURER = """aa AS (SELECT p.uri, p.sure, p.hash, arg_max({'u': q.uri, 'h': q.hash, 's': q.sure}, (q.us, q.uri, q.hash, q.sure)) AS prior FROM pp p JOIN hh q ON p.author = q.author AND p.fp = q.fp AND q.us < p.us GROUP BY ALL)"""
FIRST_DATE = r"regexp_extract(text, '(\d{4}-\d{2}-\d{2})', 1)"
