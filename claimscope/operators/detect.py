"""Detections: envelopes, their order, cooldown, and sensors over a series.

What needs an ordered fold over state (cooldown, moving baselines, stream health) is one Python fold shared by batch
and stream. A fold's group is one detection identity, sensor or stream: as long as its number of windows, never of posts.
Envelopes are built where at most a few hundred rows are left, after the report's own limits.
"""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from least to most.
SEVERITIES = ("info", "low", "med", "high", "critical")
TOP, PER_SENSOR, LISTED, CHARS = 100, 20, 10, 200


def canonical(x):
    """Numbers rounded to 6 digits, sets as sorted lists; infinities and unknown types are refused."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError(f"not a finite number: {x}")
        return round(x, 6)
    if isinstance(x, dict):
        return {k: canonical(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted((canonical(v) for v in x), key=stable_json)
    if isinstance(x, (list, tuple)):
        return [canonical(v) for v in x]
    raise TypeError(f"no canonical form of {type(x).__name__}")


def stable_json(x) -> str:
    return json.dumps(canonical(x), sort_keys=True, allow_nan=False, separators=(",", ":"))


def receipt(x) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(stable_json(x).encode()).hexdigest()[:16]


def capped(explain: dict) -> dict:
    """Lists of 10 and texts of 200 at most; ``truncated`` if a value on the top level was longer."""
    def cap(v):
        if isinstance(v, str):
            return v[:CHARS]
        if isinstance(v, list):
            return [cap(i) for i in v[:LISTED]]
        return {k: cap(i) for k, i in v.items()} if isinstance(v, dict) else v

    long = any((isinstance(v, list) and len(v) > LISTED) or (isinstance(v, str) and len(v) > CHARS) for v in explain.values())
    return {k: cap(v) for k, v in explain.items()} | ({"truncated": True} if long else {})


def window_name(ts_start: str, ts_end: str, window: str, config_hash: str, coverage: float = 0, state: str = "unknown", schema: int = 1) -> str:
    """Commits to the window and settings that a detection covers."""
    return receipt({"ts_start": ts_start, "ts_end": ts_end, "window": window, "schema_version": schema, "config_hash": config_hash, "watermark_coverage": coverage, "watermark_state": state})


def detection_id(detector: str, version: str, window_fp: str, subject_type: str, subject: str, kind: str) -> str:
    named = {"detector_id": detector, "detector_version": version, "window_fingerprint": window_fp or "m1_unfingerprinted", "subject_type": subject_type, "subject_value": subject, "type": kind}
    return receipt(named)


def envelope(d: dict, window: dict, evidence: list[dict] = ()) -> dict:
    """The signed form of one detection row."""
    e = {
        "envelope_schema_version": 1, "detector_id": d["detector_id"], "detector_version": d.get("detector_version", "v1"), **window,
        "subject": {"type": d["subject_type"], "value": d["subject_value"]}, "type": d["type"], "score": round(d["score"], 6), "severity": d["severity"],
        "explain": capped(d.get("explain", {})), "evidence": sorted(evidence, key=lambda x: (x["kind"], x["ref"])), "receipt_hash": "",
    }
    e["det_id"] = detection_id(e["detector_id"], e["detector_version"], window.get("window_fingerprint", ""), d["subject_type"], d["subject_value"], d["type"])
    return e | {"receipt_hash": receipt(e)}


def plain_sql(sql: str) -> str:
    """A statement with its white space collapsed, so that layout doesn't change its name."""
    return " ".join(sql.split())


# Kinds of evidence and of subjects that an envelope may have.
EVIDENCE = ("query_commitment", "event_range", "hashset_root", "note")
SUBJECTS = ("did", "uri", "fingerprint", "family", "global", "stream")


def query_evidence(sql: str, params: list, result: str) -> dict:
    return {"kind": "query_commitment", "ref": receipt({"sql_norm": plain_sql(sql), "params": params, "result_hash": result})}


def range_evidence(start: str, end: str, events: int) -> dict:
    return {"kind": "event_range", "ref": receipt({"cursor_start": start, "cursor_end": end, "events_in": events})}


def set_evidence(subjects: list, total: int) -> dict:
    return {"kind": "hashset_root", "ref": receipt({"subjects": sorted(subjects), "n": total})}


def note_evidence(text: str) -> dict:
    return {"kind": "note", "ref": text[:CHARS]}


def faults(e: dict) -> list[str]:
    """What is wrong with an envelope; nothing if it is empty."""
    subject = e.get("subject") or {}
    checks = {
        "schema version": e.get("envelope_schema_version") == 1, "subject": bool(subject), "subject type": not subject or subject.get("type") in SUBJECTS,
        "severity": e.get("severity") in SEVERITIES, "evidence of a named window": bool(e.get("evidence")) or not e.get("window_fingerprint"),
        "evidence kind": all(x.get("kind") in EVIDENCE for x in e.get("evidence", ())),
        "length of explain": all(len(v) <= (CHARS if isinstance(v, str) else LISTED) for v in e.get("explain", {}).values() if isinstance(v, (str, list))),
        "receipt": e.get("receipt_hash") == receipt(e | {"receipt_hash": ""}),
    }
    return [name for name, ok in checks.items() if not ok]


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity).cast("int") - 1, F.lit(-1))


def graded(score: Column, steps: tuple[tuple[float, str], ...]) -> Column:
    """The severity of the highest step that a score reaches; steps fall."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(score >= least, name)
    return out


def burst_detections(bursts: DataFrame) -> DataFrame:
    """Bursts of score 1 and more as detections."""
    s = F.col("burst_score")
    return bursts.where(s >= 1).select(
        F.lit("burst").alias("detector_id"), F.lit("fingerprint").alias("subject_type"), F.col("fp").alias("subject_value"), F.lit("burst").alias("type"), s.alias("score"),
        F.coalesce(graded(s, ((5.0, "high"), (3.0, "med"), (2.0, "low"))), F.lit("info")).alias("severity"),
    )


def regime_detections(shifts: DataFrame) -> DataFrame:
    s = F.col("jsd")
    return shifts.where("shifted").select(
        F.lit("regime_shift").alias("detector_id"), F.lit("global").alias("subject_type"), F.col("bin").cast("string").alias("subject_value"), F.lit("regime_shift").alias("type"), s.alias("score"),
        F.coalesce(graded(s, ((0.7, "high"), (0.5, "med"), (0.3, "low"))), F.lit("info")).alias("severity"),
    )


def ranked(detections: DataFrame, per_detector: int = PER_SENSOR, top: int = TOP) -> DataFrame:
    """Detections of a report: the worst of each detector, then the worst of all, in order."""
    order = [F.desc(severity_rank(F.col("severity"))), F.desc("score"), F.col("detector_id"), F.col("subject_type"), F.col("subject_value")]
    own = F.row_number().over(Window.partitionBy("detector_id").orderBy(*order))
    return detections.withColumn("r", own).where(F.col("r") <= per_detector).drop("r").orderBy(*order).limit(top)


def severity_table(detections: DataFrame) -> DataFrame:
    return detections.groupBy("detector_id").pivot("severity", list(SEVERITIES)).count().na.fill(0)


# --- folds ---

def cooldown_fold(rows: list[tuple[int, float, str]], windows: int = 5, delta: float = 0.5, state=None):
    """Which of one identity's detections (window, score, severity), in order, are let through, and the state after them.

    Let through is the first, one ``windows`` after the last let through, one more severe, or one ``delta`` higher in score.
    """
    out = []
    for window, score, severity in rows:
        rank = SEVERITIES.index(severity) if severity in SEVERITIES else -1
        go = state is None or window - state[0] >= windows or rank > state[2] or score - state[1] >= delta
        if go:
            state = (window, score, rank)
        out.append(go)
    return out, state


def cooled(detections: DataFrame, windows: int = 5, delta: float = 0.5) -> DataFrame:
    """Detections (det_id, window_no, score, severity, ...) with ``emitted``."""
    schema = detections.schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window_no", "score"], kind="stable")
        pdf["emitted"], _ = cooldown_fold(list(zip(pdf["window_no"], pdf["score"], pdf["severity"])), windows, delta)
        return pdf

    return detections.groupBy("det_id").applyInPandas(fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema.fields) + ", emitted boolean")


def ewma(values: list[float], alpha: float) -> list[float]:
    """The moving average of values in order: each value's weight is alpha; the first seeds it, and so does one after 0."""
    out: list[float] = []
    for x in values:
        out.append(x if not out or out[-1] == 0.0 else alpha * x + (1 - alpha) * out[-1])
    return out


def averaged(rows: DataFrame, by: list[str], value: str, alpha: float) -> DataFrame:
    """The rows with ``base``: the moving average of a value in order of bins, the bin included. Rows are one a bin, so folds are short."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", base double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        pdf["base"] = ewma(pdf[value].tolist(), alpha)
        return pdf

    return rows.groupBy(*by).applyInPandas(fold, kinds)


def concentration(series: DataFrame, alpha: float = 2 / 25, relative: float = 0.5, absolute: float = 0.3) -> DataFrame:
    """(bin, herfindahl, baseline, increase, severity): how concentrated the posts of each bin are; severity only if anomalous.

    The baseline, a moving average, already includes the bin.
    """
    total = F.sum("posts").cast("double")
    h = series.groupBy("bin").agg((F.sum(F.col("posts").cast("double") * F.col("posts")) / (total * total)).alias("h"))
    inc = (F.col("h") - F.col("base")) / F.col("base")
    odd = (inc > relative) | (F.col("h") > absolute)
    sev = F.when(F.col("h") > 0.6, "high").when(F.col("h") > 0.4, "med").when(F.col("h") > 0.3, "low").otherwise("info")
    return averaged(h, [], "h", alpha).select("bin", F.round("h", 6).alias("herfindahl"), F.round("base", 6).alias("baseline"), F.round(inc, 4).alias("increase"), F.when(odd, sev).alias("severity"))


def author_velocity(series: DataFrame, top: int = 20, alpha: float = 2 / 25) -> DataFrame:
    """(fp, bin, ratio, baseline, change, severity) of the fingerprints with most posts: authors a post against the bins before.

    The baseline is the moving average before the bin. More authors a post is spread, fewer amplification.
    """
    busiest = series.groupBy("fp").agg(F.sum("posts").alias("p")).orderBy(F.desc("p"), "fp").limit(top).select("fp")
    each = series.join(busiest, "fp", "left_semi").select("fp", "bin", (F.col("authors").cast("double") / F.col("posts")).alias("ratio"))
    rows = averaged(each, ["fp"], "ratio", alpha).withColumn("base", F.lag("base").over(Window.partitionBy("fp").orderBy("bin")))
    c = (F.col("ratio") - F.col("base")) / F.col("base")
    sev = F.when(c > 2, "high").when(c > 1, "med").when(c > 0.5, "low").when(c < -0.8, "high").when(c < -0.6, "med").when(c < -0.4, "low")
    return rows.select("fp", "bin", F.round("ratio", 6).alias("ratio"), F.round("base", 6).alias("baseline"), F.round(c, 4).alias("change"), sev.alias("severity"))


# --- stream health ---

# The thresholds of the health machine.
HEALTH = {
    "warmup": 5, "alpha": 2 / 31, "coverage_low": 0.6, "coverage_ok": 0.8, "lag_high": 120.0, "lag_ok": 30.0, "backlog": 100, "drop_high": 0.02,
    "bad": 3, "good": 5, "recalibrate": 3, "heartbeat": 10,
}
HEALTH_START = {"state": "warming_up", "seen": 0, "baseline": 0.0, "backlog": None, "low": 0, "lag": 0, "drop": 0, "growing": 0, "good": 0, "recal": 0, "beat": 0}


def health_step(s: dict, events: int, seconds: float, backlog: int, dropped: int, lag: float, k: dict = HEALTH) -> tuple[dict, dict]:
    """One window of the health machine: (state after, row). The baseline stands still while degraded."""
    s = dict(s, seen=s["seen"] + 1)
    eps = events / max(seconds, 1.0)
    if s["state"] != "degraded":
        s["baseline"] = eps if s["baseline"] == 0.0 else k["alpha"] * eps + (1 - k["alpha"]) * s["baseline"]
    share = dropped / max(events + dropped, 1)
    coverage = min(eps / max(s["baseline"], 1e-6), 1.0)
    change = None if s["backlog"] is None else backlog - s["backlog"]
    s["backlog"] = backlog
    bad = {"low": coverage < k["coverage_low"], "lag": lag > k["lag_high"], "drop": share > k["drop_high"], "growing": change is not None and change > k["backlog"] and lag > k["lag_ok"]}
    for name, is_bad in bad.items():
        s[name] = s[name] + 1 if is_bad else 0
    names = {"low": "platform_low_eps", "lag": "lag_high", "drop": "high_drop_rate", "growing": "consumer_backlog"}
    reasons, event = [n for c, n in names.items() if s[c] >= k["bad"]], ""
    if s["state"] == "degraded":
        s["beat"] += 1
        if s["beat"] >= k["heartbeat"]:
            event, s["beat"] = "platform_degraded", 0
        steady = change is not None and abs(change) < k["backlog"]
        s["good"] = s["good"] + 1 if coverage > k["coverage_ok"] and lag < k["lag_ok"] and steady else 0
        if s["good"] >= k["good"]:
            s |= {"state": "ok", "recal": k["recalibrate"], "good": 0}
            reasons, event = [], "platform_recovered"
    elif reasons and (s["state"] == "ok" or s["seen"] >= k["warmup"]):
        s["recal"] = 0 if s["state"] == "ok" else s["recal"]
        s |= {"state": "degraded", "beat": 0, "good": 0}
        event = "platform_degraded"
    elif s["state"] == "warming_up" and s["seen"] >= k["warmup"]:
        s["state"] = "ok"
    if s["recal"] > 0:
        s["recal"] -= 1
    gated = s["state"] == "degraded" or s["recal"] > 0 or (s["state"] == "warming_up" and lag > k["lag_high"])
    row = {"state": s["state"], "eps": eps, "baseline": s["baseline"], "coverage": coverage, "drop_frac": share, "reasons": ",".join(reasons), "gated": gated, "event": event}
    return s, row


# Version of a saved baseline, and its age in seconds up to which it is taken.
SAVED_VERSION, SAVED_AGE = 1, 3600


def saved_health(state: dict, at: float) -> dict:
    """What is kept of the health machine when it stops: its baseline and how long it has seen windows."""
    return {"version": SAVED_VERSION, "baseline": state["baseline"], "seen": state["seen"], "at": at}


def restored_health(saved: dict | None, now: float) -> dict:
    """The machine's first state: from what was saved, in state ok once warm, or cold if that is old, of another version or empty."""
    if not saved or saved.get("version") != SAVED_VERSION or now - saved.get("at", 0) > SAVED_AGE or saved.get("baseline", 0) <= 0:
        return dict(HEALTH_START)
    warm = saved["seen"] >= HEALTH["warmup"]
    return dict(HEALTH_START, baseline=saved["baseline"], seen=saved["seen"], state="ok" if warm else "warming_up")


def health_detections(rows: DataFrame) -> DataFrame:
    """Transitions and heartbeats of the health machine as detections; a recovery is for information."""
    return rows.where("event <> ''").select(
        F.lit("platform_health").alias("detector_id"), F.lit("stream").alias("subject_type"), F.col("stream").alias("subject_value"), F.col("event").alias("type"),
        F.round(1 - F.col("coverage"), 6).alias("score"), F.when(F.col("event") == "platform_recovered", "info").otherwise("high").alias("severity"), "window_no",
    )


def stream_lag(arrivals: DataFrame, alpha: float = 0.2, most: float = 600.0) -> DataFrame:
    """(window, lag_s): the moving average of the lag of arrivals (window, at, no, lag_s) in order, at the end of each window.

    A lag is held between 0 and ``most``; an average of 0 is seeded anew; unknown lags change nothing. Arrivals are weighed
    within their window, and the windows, one row each, are folded in order.
    """
    x = F.when(F.col("lag_s").isNotNull(), F.least(F.greatest(F.col("lag_s"), F.lit(0.0)), F.lit(most)))
    rows = arrivals.select("window", "at", "no", x.alias("x"))
    seed = rows.where("x > 0").agg(F.min(F.struct("at", "no")).alias("seed"))  # one row
    later = F.row_number().over(Window.partitionBy("window", F.isnull("x")).orderBy(F.desc("at"), F.desc("no"))) - 1
    weight = F.when(F.struct("at", "no") == F.col("seed"), 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), later)
    each = rows.crossJoin(seed).withColumn("w", weight).groupBy("window").agg(F.count("x").alias("n"), F.coalesce(F.sum(F.col("x") * F.col("w")), F.lit(0.0)).alias("b"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, lag, out = pdf.sort_values("window"), 0.0, []
        for n, b in zip(pdf["n"], pdf["b"]):
            lag = lag * (1 - alpha) ** n + b
            out.append(lag)
        return pd.DataFrame({"window": pdf["window"], "lag_s": out})

    kind = arrivals.schema["window"].dataType.simpleString()
    return each.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: fold(pdf), f"window {kind}, lag_s double")


def health(windows: DataFrame) -> DataFrame:
    """The health machine over (stream, window_no, events_in, window_secs, backlog, dropped, lag_s): a fold a stream.

    A stream has one row a window, so a group is small however busy the stream.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = HEALTH_START, []
        for r in pdf.sort_values("window_no").itertuples():
            s, row = health_step(s, int(r.events_in), float(r.window_secs), int(r.backlog), int(r.dropped), float(r.lag_s))
            out.append({"stream": r.stream, "window_no": r.window_no} | row)
        return pd.DataFrame(out)

    return windows.groupBy("stream").applyInPandas(
        fold, "stream string, window_no long, state string, eps double, baseline double, coverage double, drop_frac double, reasons string, gated boolean, event string"
    )
