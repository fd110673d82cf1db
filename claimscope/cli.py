"""Command line: python -m claimscope.cli report|export|health|drift ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from claimscope.runtime import session, table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="claimscope")
    sub = p.add_subparsers(dest="command", required=True)
    for name, says in (("report", "cluster report as JSON"), ("summary", "cluster report as text"), ("export", "one export cycle"), ("health", "stream health by hour"), ("drift", "labels of the drift rules for a file of posts")):
        s = sub.add_parser(name, help=says)
        s.add_argument("source", help="folder of tables, or the posts file")
        s.add_argument("--as-of", default="2023-11-05 12:00:00")
        s.add_argument("--hours", type=int, default=24)
        s.add_argument("--out")
    a = p.parse_args(args)
    spark = session()
    from claimscope.operators import drift, export, report
    from claimscope.plans import cluster_queries, detect_queries
    from claimscope.sources import files

    if a.command in ("report", "summary"):
        got = report.cluster_report(cluster_queries.claims(spark, a.source), cluster_queries.decisions(spark, a.source), a.as_of, report.ReportConfig(hours=a.hours))
        print(json.dumps(got, default=str, sort_keys=True) if a.command == "report" else report.summary(got))
    elif a.command == "export":
        print(json.dumps(export.export_cycle(spark, cluster_queries.claims(spark, a.source), table(spark, a.source, "actor_identity"), a.out or "facts", a.as_of)))
    elif a.command == "health":
        for r in detect_queries.stream_health(spark, a.source).where("event <> ''").orderBy("window_no").toLocalIterator():
            print(json.dumps(r.asDict()))
    else:
        from claimscope.functions import claim_text as ct

        n = lambda c: F.coalesce(F.size(c), F.lit(0))
        posts = files.posts(spark, a.source).select(
            "uri", F.col("authorDid").alias("author"), F.coalesce("replyRootUri", "uri").alias("root"), F.try_to_timestamp("createdAt").alias("ts"), F.coalesce("text", F.lit("")).alias("text"),
            n("externalLinks").alias("n_links"), n("embeds").alias("n_embeds"), n("facets").alias("n_facets"), ct.evidence_hash("externalLinks", "embeds", "facets").alias("evidence_hash"),
            ct.fingerprint(F.col("text"))["fp"].alias("fp"),
        )
        files.write_lines(drift.label_lines(drift.all_rules(posts, posts)), a.out or "labels")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
