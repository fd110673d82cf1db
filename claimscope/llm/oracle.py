"""SQL for the corpus queries that SQL can express."""

from claimscope.plans import sql

_SHAPES = [("", []), ("day", ["day"]), ("fp_kind", ["fp_kind"]), ("evidence_class", ["evidence_class"]), ("day+fp_kind", ["day", "fp_kind"]),
           ("day+evidence_class", ["day", "evidence_class"]), ("fp_kind+evidence_class", ["fp_kind", "evidence_class"]), ("day+fp_kind+evidence_class", ["day", "fp_kind", "evidence_class"])]


def _counts(source: str, day: str, before: str = "") -> str:
    parts = []
    for name in ("author_did", "fingerprint"):
        for label, kept in _SHAPES:
            columns = ", ".join(f"{c} AS {c}" if c in kept else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("day", "fp_kind", "evidence_class"))
            group = f" GROUP BY {', '.join(kept)}" if kept else ""
            parts.append(
                f"SELECT '{name}' AS identifier, '{label}' AS \"grouping\", {columns}, count(DISTINCT {name}) AS n, CAST(0.0 AS DOUBLE) AS error_bound FROM c WHERE {name} IS NOT NULL{group}"
            )
    return (
        f"WITH {before}c AS (SELECT author_did, " + r"lower(regexp_replace(claim_fingerprint, '[^\p{L}\p{N}]', '', 'g')) AS fingerprint, "
        f"CAST(CAST({day} AS DATE) AS VARCHAR) AS day, fp_kind, evidence_class FROM {source}) " + " UNION ALL ".join(parts)
    )


_GRAMS = """g AS (SELECT doc_id, CAST(i AS BIGINT) AS i, hash(substr(text, CAST(i AS BIGINT), 300)) AS h
                   FROM documents, range(1, CAST(length(text) - 298 AS BIGINT)) t(i) WHERE length(text) >= 300)"""

ORACLE = {
    "p4_distinct_counts": _counts("ic", "coalesce(make_timestamp(us), observed_at)", sql.instants("ic", "claim_history", "created_at") + ", "),
    "p4_distinct_by_arrival": _counts("claim_history", "observed_at"),
    "p10_shared_lengths": f"""
        WITH {_GRAMS}, s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1), w AS (SELECT g.* FROM g JOIN s USING (h)),
        c AS (SELECT doc_id, sum(least(300, coalesce(nx - i, 300))) AS shared_chars FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM w) GROUP BY doc_id),
        p AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS partners FROM w a JOIN (SELECT DISTINCT doc_id, h FROM w) b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id)
        SELECT c.doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(shared_chars AS BIGINT) AS shared_chars, partners FROM c JOIN p USING (doc_id) JOIN documents USING (doc_id)""",
    "p4_day_authors": """
        WITH e AS (SELECT author, claim_fingerprint AS fingerprint, CAST(CAST(ctime AS DATE) AS VARCHAR) AS day, date_trunc('hour', ctime) AS hour
                   FROM post_events WHERE author IS NOT NULL),
        h AS (SELECT fingerprint, day, hour, count(DISTINCT author) AS n FROM e GROUP BY ALL),
        s AS (SELECT fingerprint, day, CAST(sum(n) AS BIGINT) AS added_up FROM h GROUP BY ALL)
        SELECT fingerprint, day, count(DISTINCT author) AS authors, any_value(added_up) AS added_up FROM e JOIN s USING (fingerprint, day) GROUP BY ALL""",
    "p7_claim_copies": r"""
        WITH c AS (SELECT seq, author_did, post_uri, lower(regexp_replace(claim_fingerprint, '[^\p{L}\p{N}]', '', 'g')) AS f FROM claim_history
                   WHERE author_did IS NOT NULL AND post_uri IS NOT NULL AND claim_fingerprint IS NOT NULL)
        SELECT min(seq) AS first_seq, count(*) AS copies FROM c GROUP BY author_did, post_uri, f HAVING count(*) > 1""",
    "p10_found": """
        WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, CAST(i AS BIGINT), 300)) AS h
                   FROM documents, range(1, CAST(length(text) - 298 AS BIGINT)) t(i) WHERE length(text) >= 300)
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
