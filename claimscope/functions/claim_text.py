"""Claim signals and fingerprints of a text, as column expressions.

Only Unicode compatibility folding of non-ASCII text leaves the JVM, in Arrow batches; ASCII texts don't.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# word characters and their borders, as letters, numbers and underscore alone (Java's own \\b also counts joiners and marks)
_W = r"[\p{L}\p{N}_]"
_B = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# What a date, a number, a name and a modal are. Each begins with a look at the first character, which most places fail at once
DATE = rf"(?=\p{{Nd}})(?<!{_W})(\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}})(?!{_W})"
QUANTITY = rf"(?i)(?=\p{{Nd}})(?<!{_W})\p{{Nd}}[\p{{Nd}}.,]*k?{_B}"
ENTITY = rf"(?U)(?=[A-Z])(?<!{_W})([A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]{{2,}})*)(?!{_W})"
MODAL = rf"(?iU)(?=[acdgprs])(?<!{_W})(definitely|confirmed|proved|certainly|sure|guaranteed|reported|reportedly|according to)(?!{_W})"
URL = r"https?://\S+"
# Capitalised function words that are no entity on their own.
ENTITY_STOPLIST = """
That This They The And But What When Where Why How Today Yesterday Tomorrow Here There These Those Just Also Still Even
Very Really Only Some Many Most Every All Any Each Both Such Other Another Not Now Then Well Like Been Being Have Has Had
Was Were Are Will Would Could Should May Might Must Can Did Does Got Get Let Yes Our His Her Its Your Their Who Which
""".split()
# Phrases that attribute a claim.
ATTRIBUTION = ("reportedly", "according to", "source says", "reported by", "sources say")
# Words before the object of a claim.
PREPOSITIONS = "in by from at near inside over on under around within".split()
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FAFF}\\x{2702}-\\x{27B0}\\x{FE00}-\\x{FE0F}\\x{200D}]+"


@dataclass(frozen=True)
class FingerprintConfig:
    """What a fingerprint depends on. The word lists are fixed values."""

    version: str = "v1"
    keep_quotes: bool = False
    numbers: str = "bucket"  # bucket, exact or redact
    entities: str = "none"  # none, handles or domain
    modal: tuple[str, ...] = ("confirmed", "reported", "according", "report", "said", "says")
    entity_stop: tuple[str, ...] = ("about", "per", "some", "see", "screenshot", "report", "reporting", "source", "approximately", "approx")
    context_stop: tuple[str, ...] = ("people", "were", "in", "the", "a", "of", "per", "some", "about", "see", "report", "screenshot", "reported", "according", "source")
    hedges: tuple[str, ...] = ("think", "maybe", "might", "could", "possibly", "suggests", "about", "approximately")

    def hash(self) -> str:
        """Names the settings; equal for equal settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


DEFAULT = FingerprintConfig()


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose names survive wherever the expression is moved."""
    return F.named_struct(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), 1)


def quantities(text: Column) -> Column:
    """Number tokens but bare years and tokens that also stand, as a run of digits, in a link."""
    in_links = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(URL), 0), lambda u: F.regexp_extract_all(u, F.lit(r"\d+"), 0)))
    found = F.regexp_extract_all(text, F.lit(QUANTITY), 0)
    return F.filter(found, lambda q: ~q.rlike(r"^(19|20)\d{2}$") & ~F.array_contains(in_links, q))


def entities(text: Column) -> Column:
    """Capitalised phrases; single words only outside the stop list."""
    stop = _strings(ENTITY_STOPLIST)
    return F.filter(F.regexp_extract_all(text, F.lit(ENTITY), 1), lambda e: e.contains(" ") | ~F.array_contains(stop, e))


def modals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MODAL), 1)


def spans(text: Column) -> Column:
    """Sentences with a date, a number or a modal. Every date begins with a number."""
    parts = F.split(text, r"(?U)(?<=[.?!])\s+", -1)
    return F.transform(F.filter(parts, lambda s: s.rlike(QUANTITY) | s.rlike(MODAL)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def signals(text: Column) -> Column:
    """(spans, dates, quantities, entities, modal) of a text; of null, as of an empty text."""
    t = F.coalesce(text, F.lit(""))
    return record(spans=spans(t), dates=dates(t), quantities=quantities(t), entities=entities(t), modal=modals(t))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else [" ".join(unicodedata.normalize("NFKC", s or "").split()) for s in t] for t in texts.to_pylist()], pa.list_(pa.string()))


def folded(texts: Column) -> Column:
    """Each string of an array in compatibility form, white space collapsed."""
    ascii_only = F.forall(texts, lambda t: t.rlike(r"\A\p{ASCII}*\z"))
    plain = F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.coalesce(_folded(F.when(~ascii_only, texts)), plain)


def magnitude(token: Column) -> Column:
    """The whole number that a token means (k: thousands; European and American marks), halves to even; null if none."""
    s = F.lower(F.trim(token))
    bare = F.replace(s, F.lit(","), F.lit(""))
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dot, comma = F.instr(s, "."), F.instr(s, ",")
    decimal = F.when((dot > 0) & (comma > 0) & (dot < comma), european).otherwise(bare).try_cast("double")
    return (
        F.when(s.endswith("k"), F.bround(F.regexp_replace(bare, "k$", "").try_cast("double") * 1000, 0))
        .when(dot > 0, F.bround(decimal, 0))
        .otherwise(bare.try_cast("decimal(38,0)").cast("double"))
    )


def _digits(n: Column) -> Column:
    return n.cast("decimal(38,0)").cast("string")


def number(token: Column, config: FingerprintConfig = DEFAULT) -> Column:
    """A number token in the configured grain; what isn't a number stays."""
    return let(record(n=magnitude(token), token=token), lambda x: F.coalesce(_grain(x["n"], config), x["token"]))


def _grain(n: Column, config: FingerprintConfig) -> Column:
    if config.numbers == "redact":
        return F.when(n.isNotNull(), F.lit("<NUM>"))
    if config.numbers == "exact":
        return _digits(n)
    whole = n.cast("decimal(38,0)")
    return (
        F.when(n < 10, _digits(n))
        .when(n < 100, _digits(F.bround(whole / 10, 0) * 10))
        .when(n < 1000, _digits(F.bround(whole / 100, 0) * 100))
        .otherwise(F.concat(_digits(F.bround(n / 1000, 0)), F.lit("k")))
    )


def normal_text(form: Column, config: FingerprintConfig = DEFAULT) -> Column:
    """Words of a folded text in lower case, numbers in their grain, quotations left out."""
    if not config.keep_quotes:
        form = F.regexp_replace(F.regexp_replace(form, r'"[^"]*"', ""), r"'[^']*'", "")
    tokens = F.regexp_extract_all(form, F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{Nd}+$"), number(t, config)).otherwise(F.lower(t))), " ")


def link_domains(text: Column) -> Column:
    """Sorted distinct hosts of the links in a text, without port and www."""
    hosts = F.transform(
        F.regexp_extract_all(text, F.lit(URL), 0),
        lambda u: F.regexp_replace(F.regexp_extract(F.lower(u), r"^https?://([^/?#:]*)", 1), r"^www\.", ""),
    )
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def _entity(e: Column, config: FingerprintConfig) -> Column:
    e = F.trim(e)
    if config.entities == "handles":
        return F.when(e.startswith("@"), F.lower(e)).otherwise(e)
    if config.entities == "domain":
        host = F.regexp_extract(e, r"^https?://([^/:]+)", 1)
        return F.when(host != "", F.lower(host)).otherwise(e)
    return e


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def fingerprint_source(text: Column, config: FingerprintConfig = DEFAULT) -> Column:
    """(source, kind): what is hashed. The strongest signal wins; numbers add to multi-word names."""
    t = F.coalesce(text, F.lit(""))
    forms = folded(F.concat(spans(t), F.array(t)))
    barred = _strings(config.modal + config.entity_stop)
    # Fixed value: a place or agent after its preposition.
    place = rf"(?iU)(?=[ib])(?<!{_W})(in|by)\s+([A-Za-z0-9_\-]{{2,}})"

    def listed(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(F.array_sort(values), ",")))

    def parts(x: Column) -> Column:
        """From the signals: each part that a source may have, or null."""
        first = F.get(x["spans"], F.lit(0))
        amounts = F.transform(F.array_sort(x["quantities"]), lambda a: number(a, config))
        return record(
            multi=listed("E:", F.filter(x["names"], lambda e: e.contains(" "))), single=listed("E:", F.filter(x["names"], lambda e: ~e.contains(" "))),
            q=F.when(F.size(amounts) > 0, F.concat(F.lit("Q:"), F.array_join(amounts, ","))),
            prep=F.lower(F.regexp_extract(first, place, 1)), object=F.lower(F.regexp_extract(first, place, 2)),
            d=listed("D:", x["domains"]),
        )

    def joined(p: Column, x: Column) -> Column:
        """Branches are only computed where they are taken: most texts need none of the normalised ones."""
        rest = F.split(F.trim(F.regexp_replace(normal_text(F.get(x["forms"], F.lit(0)), config), QUANTITY, "")), r"\s+")
        word = F.get(F.filter(rest, lambda w: (F.length(w) > 3) & ~F.array_contains(_strings(config.context_stop), w)), F.lit(0))
        barred_words = _strings(config.hedges + config.modal + config.entity_stop)
        known = (p["object"] != "") & ~F.array_contains(_strings(config.context_stop + config.entity_stop), p["object"])
        context = F.when(known, F.concat(F.lit("P:"), p["prep"], F.lit(":"), p["object"])).otherwise(let(word, lambda w: F.when(~F.array_contains(barred_words, w), F.concat(F.lit("C:"), w))))
        has_spans = F.size(x["spans"]) > 0
        strong = let(F.array_join(F.array_compact(F.array(p["multi"], p["q"], F.when(p["q"].isNotNull() & has_spans, context))), "|"), _nonempty)
        s = listed("S:", F.transform(F.slice(x["forms"], F.lit(1), F.size(x["spans"])), lambda f: normal_text(f, config)))
        plain = F.concat(F.lit("T:"), normal_text(F.element_at(x["forms"], -1), config))
        kinds = (("multi", "entity"), ("q", "quantity"), ("d", "domain"), ("single", "entity"))
        kind = F.coalesce(*(F.when(p[c].isNotNull(), F.lit(k)) for c, k in kinds), F.when(has_spans, "span"), F.lit("text"))
        return record(source=F.coalesce(strong, p["d"], p["single"], s, plain), kind=kind)

    names = F.transform(F.filter(entities(t), lambda e: ~F.array_contains(barred, F.lower(e))), lambda e: _entity(e, config))
    raw = record(spans=spans(t), quantities=quantities(t), names=names, domains=link_domains(t), forms=forms)
    return let(raw, lambda x: let(parts(x), lambda p: joined(p, x)))


def fingerprint(text: Column, config: FingerprintConfig = DEFAULT) -> Column:
    """(fp, kind): the first 16 hexadecimal digits of the source's SHA-256."""
    return let(fingerprint_source(text, config), lambda x: record(fp=F.substring(F.sha2(x["source"], 256), 1, 16), kind=x["kind"]))


def complex_enough(text: Column, links: Column | None = None, embeds: Column | None = None, facets: Column | None = None, least: int = 3) -> Column:
    """Whether a text carries a claim: three words, an entity, or any evidence with it. Blank texts don't."""
    text = F.coalesce(text, F.lit(""))
    clean = F.regexp_replace(text, EMOJI, "")
    held = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in (links, embeds, facets) if c is not None]
    enough = (F.size(F.regexp_extract_all(clean, F.lit(rf"(?=[a-zA-Z])(?<!{_W})[a-zA-Z]{{3,}}(?!{_W})"), 0)) >= least) | (F.size(entities(text)) > 0)
    for h in held:
        enough = h | enough
    return F.coalesce(F.trim(text) != "", F.lit(False)) & enough


def assertiveness(text: Column) -> Column:
    return F.least(F.lit(1.0), F.size(modals(F.coalesce(text, F.lit("")))) / F.lit(3.0))


def attributed(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(_strings(ATTRIBUTION), lambda a: F.contains(low, a))


def comparable(prior: Column, current: Column) -> Column:
    """Whether one text holds the other, or a word of the prior with more than four letters stands in the current."""
    p, c = (F.btrim(F.replace(F.lower(x), F.lit("\n"), F.lit(" "))) for x in (prior, current))
    return F.contains(p, c) | F.contains(c, p) | F.exists(F.split(p, r"\s+"), lambda w: (F.length(w) > 4) & F.contains(c, w))


def preposition_tokens(text: Column) -> Column:
    """``preposition:object`` of each place in the text."""
    pattern = F.lit(rf"(?iU)(?=[a-z])(?<!{_W})(" + "|".join(PREPOSITIONS) + r")\s+([A-Za-z0-9_\-]{2,})")
    return F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda p, o: F.concat(F.lower(p), F.lit(":"), F.lower(o)))


def evidence_class(links: Column, embeds: Column, facets: Column) -> Column:
    """none, link, embed, facet, or mixed if more than one kind of evidence is there."""
    has = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in (links, embeds, facets)]
    n = sum((h.cast("int") for h in has[1:]), has[0].cast("int"))
    return F.when(n > 1, "mixed").when(has[0], "link").when(has[1], "embed").when(has[2], "facet").otherwise("none")


@F.arrow_udf(T.StringType())
def evidence_hash(links: pa.Array, embeds: pa.Array, facets: pa.Array) -> pa.Array:
    """Names a post's evidence: its links without query, its embeds and facets as JSON text, each sorted."""
    from urllib.parse import urlparse

    def texts(items):
        return sorted(json.dumps(json.loads(x), sort_keys=True) for x in items or [])

    def one(ls, es, fs):
        plain = sorted(urlparse(u)._replace(params="", query="", fragment="").geturl() for u in ls or [])
        named = {"links": plain, "embeds": texts(es), "facets": texts(fs)}
        return hashlib.sha256(json.dumps(named, sort_keys=True).encode()).hexdigest()[:16]

    return pa.array([one(*x) for x in zip(links.to_pylist(), embeds.to_pylist(), facets.to_pylist())], pa.string())


def plain_key(value: Column) -> Column:
    """The letters and digits of a value in lower case: what is left of a fingerprint when its formatting doesn't count."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def did_of(uri: Column) -> Column:
    """The account of an at:// address, or null."""
    return _nonempty(F.regexp_extract(uri, r"^at://(did:[^/]*)", 1))


def host_of(url: Column) -> Column:
    """Host of a URL, or of a bare host with or without port, in lower case."""
    return F.lower(_nonempty(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)))


def host_family(host: Column, deep: tuple[str, ...] = ("bsky.network", "bsky.social")) -> Column:
    """The last two labels of a host; three below domains that serve many hosts."""
    h = F.regexp_replace(F.regexp_replace(host, ":.*$", ""), r"\.+$", "")
    parts = F.split(h, r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when(F.size(parts) <= 2, h).when(two.isin(*deep), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(two)


def mutated(text: Column) -> Column:
    """(mutation, text) rows as an array: the small changes that a fingerprint should mostly survive."""
    letter = F.regexp_extract(text, r"^[^\p{L}]*(\p{L})", 1)
    small = F.when(letter == "", F.concat(text, F.lit("a"))).otherwise(
        F.concat(F.regexp_extract(text, r"(?s)^([^\p{L}]*)", 1), F.when(F.lower(letter) == "b", "c").otherwise("b"), F.regexp_extract(text, r"(?s)^[^\p{L}]*\p{L}(.*)$", 1))
    )
    # Names of the mutations and what they add.
    changes = {
        "whitespace": F.regexp_replace(F.trim(text), r"(?U)\s+", " "),
        "punctuation": F.regexp_replace(text, r"(?U)[^\w\s]", ""),
        "casefold": F.lower(text),
        "url_param": F.when(text.contains("http"), F.concat(text, F.when(text.contains("?"), "&utm=1").otherwise("?utm=1"))).otherwise(F.concat(text, F.lit(" https://example.com/?utm=1"))),
        "emoji": F.concat(text, F.lit(" \U0001f642")),
        "small_edit": small,
    }
    return F.array(*(record(mutation=F.lit(k), text=v) for k, v in changes.items()))
