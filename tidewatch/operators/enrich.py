"""Enrichment and scoring over stored provider reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once, spread_join
from tidewatch.functions.styles import pick_severity
from tidewatch.functions.text import strip_fences
from tidewatch.operators.filters import needs_alert, threat_scale
from tidewatch.sources.raw_reports import latest_raw, newest_payloads

# Owners that count as trusted infrastructure.
BIG_PLAYERS = ["AWS", "Amazon", "Cloudflare", "Google", "Microsoft", "GitHub"]
# Provider key in a verdict, and its name in the dictionary.
PROVIDER_NAMES = {"virustotal": "VirusTotal", "threatfox": "Abuse_ThreatFox", "urlhaus": "Abuse_URLhaus"}

# Layouts of the three payloads, by the providers' public API documentation.
VIRUSTOTAL_LAYOUT = (
    "data struct<attributes: struct<last_analysis_stats: struct<malicious: bigint, suspicious: bigint, "
    "undetected: bigint>, as_owner: string, last_analysis_date: bigint>>")
THREATFOX_LAYOUT = ("query_status string, data array<struct<malware_printable: string, threat_type: string, "
                    "confidence_level: bigint>>")
URLHAUS_LAYOUT = ("query_status string, urlhaus_reference string, urls array<struct<url: string, "
                  "url_status: string, threat: string>>")

# Follows the text in the array that it is parsed in; missing there if the text does not end with its value.
END_MARK = "end-of-text"


def _or_false(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def _or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0).cast("bigint"))


def reduce_virustotal(df: DataFrame, raw: str = "raw_data", big_players: list[str] | None = None) -> DataFrame:
    """Replaces the payload `raw` by the vt_ facts; a payload without counts is no data."""
    attributes = F.from_json(raw, VIRUSTOTAL_LAYOUT)["data"]["attributes"]
    names = big_players or BIG_PLAYERS
    parsed = evaluate_once(df, attributes, "_a").drop(raw)
    a, stats = F.col("_a"), F.col("_a.last_analysis_stats")
    report = F.concat(
        _or_zero(stats["malicious"]).cast("string"), F.lit(" malicious, "),
        _or_zero(stats["suspicious"]).cast("string"), F.lit(" suspicious, owner "),
        F.coalesce(a["as_owner"], F.lit("unknown")))
    return parsed.withColumns({
        "vt_no_data": stats.isNull(),
        "vt_report": F.when(stats.isNotNull(), report),
        "vt_malicious_count": _or_zero(stats["malicious"]),
        "vt_suspicious_count": _or_zero(stats["suspicious"]),
        "vt_undetected_count": _or_zero(stats["undetected"]),
        "vt_owner": a["as_owner"],
        "vt_is_big_player": _or_false(F.lower(a["as_owner"]).rlike("|".join(n.lower() for n in names))),
        "vt_scan_date": a["last_analysis_date"],
    }).drop("_a")


def reduce_threatfox(df: DataFrame, raw: str = "raw_data", min_confidence: int = 0) -> DataFrame:
    """Replaces the payload by families, types, activity and the highest confidence.

    Active means an entry of at least `min_confidence`.
    """
    parsed = evaluate_once(df, F.from_json(raw, THREATFOX_LAYOUT), "_t").drop(raw)
    entries = F.when(F.col("_t.query_status") == "ok", F.col("_t.data"))
    found = _or_false(F.size(entries) > 0)

    def names(field: str) -> Column:
        values = F.transform(entries, lambda e: e[field])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), ", ")

    families = F.when(found, F.nullif(names("malware_printable"), F.lit("")))
    types = F.when(found, F.nullif(names("threat_type"), F.lit("")))
    return parsed.withColumns({
        "tf_no_data": ~found,
        "tf_families": families,
        "tf_report": F.when(found, F.concat(F.coalesce(families, F.lit("unnamed")), F.lit(": "),
                                            F.coalesce(types, F.lit("unknown")))),
        "tf_active": _or_false(F.exists(entries, lambda e: e["confidence_level"] >= min_confidence)),
        "tf_max_confidence": F.array_max(F.transform(entries, lambda e: e["confidence_level"])),
    }).drop("_t")


def reduce_urlhaus(df: DataFrame, raw: str = "raw_data") -> DataFrame:
    """Replaces the payload by report, activity and evidence link; active means a URL is online."""
    parsed = evaluate_once(df, F.from_json(raw, URLHAUS_LAYOUT), "_u").drop(raw)
    u = F.col("_u")
    found = _or_false(u["query_status"] == "ok")
    urls = F.when(found, u["urls"])
    online = F.size(F.filter(urls, lambda e: e["url_status"] == "online"))
    return parsed.withColumns({
        "uh_no_data": ~found,
        "uh_report": F.when(found, F.concat(online.cast("string"), F.lit(" of "),
                                            F.size(urls).cast("string"), F.lit(" URLs online"))),
        "uh_active": _or_false(F.exists(urls, lambda e: e["url_status"] == "online")),
        "uh_reference": F.when(found, u["urlhaus_reference"]),
    }).drop("_u")


def merge_context(pending: DataFrame, reports: DataFrame, levels: DataFrame,
                  big_players: list[str] | None = None) -> DataFrame:
    """Queue rows with the facts of all providers.

    `reports` has one row per resource with columns vt_raw, tf_raw, uh_raw and
    their _doc_id (see `latest_by_provider`). VirusTotal is looked up by address,
    the other two by domain, together: two joins instead of three. Payloads are
    reduced before the joins, so only the compact facts travel with the queue.
    The policy lines of the level dictionary are added as one text.
    """
    by_ip = reduce_virustotal(
        reports.filter("vt_raw IS NOT NULL").select(
            F.col("resource").alias("observable_ip"), "vt_raw", "vt_doc_id"), "vt_raw", big_players)
    names = reports.filter("tf_raw IS NOT NULL OR uh_raw IS NOT NULL").select(
        F.col("resource").alias("fqdn"), "tf_raw", "tf_doc_id", "uh_raw", "uh_doc_id")
    by_name = reduce_urlhaus(reduce_threatfox(names, "tf_raw"), "uh_raw")
    merged = spread_join(spread_join(pending, by_ip, ["observable_ip"], "left"), by_name, ["fqdn"], "left")
    return _with_defaults(merged, levels)


def context_of_queue(queue: DataFrame, raw: DataFrame, levels: DataFrame, providers: dict[str, str],
                     big_players: list[str] | None = None) -> DataFrame:
    """The same context, read from the archive for the queue's own addresses and domains.

    `queue` should be a stored table, as it is read once for each provider. Each
    provider's folder is pruned, cut down to the queue and reduced before its facts
    are joined; `providers` names the providers behind vt, tf and uh.
    """
    def found(prefix: str, key: str) -> DataFrame:
        wanted = queue.select(F.col(key).alias("resource")).distinct()
        return newest_payloads(raw, providers[prefix], wanted).select(
            F.col("resource").alias(key), F.col("raw_data").alias(f"{prefix}_raw"),
            F.col("doc_id").alias(f"{prefix}_doc_id"))

    merged = spread_join(queue, reduce_virustotal(found("vt", "observable_ip"), "vt_raw", big_players),
                         ["observable_ip"], "left")
    merged = spread_join(merged, reduce_threatfox(found("tf", "fqdn"), "tf_raw"), ["fqdn"], "left")
    return _with_defaults(spread_join(merged, reduce_urlhaus(found("uh", "fqdn"), "uh_raw"), ["fqdn"], "left"), levels)


def _with_defaults(merged: DataFrame, levels: DataFrame) -> DataFrame:
    """What a missing document means, the primary hit and the policy text."""
    absent = {f"{p}_no_data": F.coalesce(f"{p}_no_data", F.lit(True)) for p in ("vt", "tf", "uh")}
    unset = {c: _or_false(F.col(c)) for c in ("vt_is_big_player", "tf_active", "uh_active")}
    counts = {c: _or_zero(F.col(c)) for c in ("vt_malicious_count", "vt_suspicious_count")}
    return merged.withColumns({**absent, **unset, **counts}).withColumns({
        "primary_hit": primary_hit(), "threat_scale": _policy_text(levels).scalar()})


def _policy_text(levels: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("score", "formatted_line")))
    text = F.array_join(F.transform(lines, lambda e: e["formatted_line"]), "\n")
    return threat_scale(levels).agg(text.alias("threat_scale"))


def primary_hit() -> Column:
    """A primary source flags the observable: engine detections, or a ThreatFox entry."""
    return (F.col("vt_malicious_count") > 0) | (F.col("vt_suspicious_count") > 0) | ~F.col("tf_no_data")


def detection_first(context: DataFrame) -> DataFrame:
    """Two-stage gate: URLhaus only supports an observable that a primary source flagged.

    `uh_status` tells a real result from a skipped one and from no result;
    the facts of a skipped lookup are blanked, so later rules cannot see them.
    """
    status = (F.when(~F.col("primary_hit"), "skip")
              .when(F.col("uh_no_data"), "no_result").otherwise("real"))
    gated = context.withColumn("uh_status", status)
    used = F.col("uh_status") == "real"
    return gated.withColumns({
        "uh_no_data": ~used,
        "uh_active": used & F.col("uh_active"),
        "uh_report": F.when(used, F.col("uh_report")),
        "uh_reference": F.when(used, F.col("uh_reference")),
    })


def apply_score_policy(context: DataFrame, levels: DataFrame, score: str = "primary_score") -> DataFrame:
    """Final score from a candidate score and the provider facts, with the level's flag and label.

    Rules in order: no data at all sets 1 or 2; an active URLhaus entry next to
    a primary hit adds one; a big player without a named family is capped at 2;
    an active ThreatFox entry sets at least 4, and wins over the cap.
    """
    silent = F.col("vt_no_data") & F.col("tf_no_data") & F.col("uh_no_data")
    named = F.coalesce(F.col("tf_families"), F.lit("")) != ""
    base = F.when(silent, F.when(F.col("vt_is_big_player"), 1).otherwise(2)).otherwise(F.col(score))
    steps = [
        lambda s: F.when(F.col("uh_active") & F.col("primary_hit"), F.least(s + 1, F.lit(5))).otherwise(s),
        lambda s: F.when(F.col("vt_is_big_player") & ~named, F.least(s, F.lit(2))).otherwise(s),
        lambda s: F.when(F.col("tf_active"), F.greatest(s, F.lit(4))).otherwise(s),
        lambda s: F.greatest(F.lit(1), F.least(s, F.lit(5))),
    ]
    scored = context.withColumn("score", reduce(lambda s, step: step(s), steps, base).cast("int"))
    labels = levels.select("score", F.col("is_malicious_flag").alias("is_malicious"),
                           F.col("action_recommended").alias("threat_label"))
    return scored.join(labels, "score", "left")


def parse_verdicts(df: DataFrame, text: str = "output") -> DataFrame:
    """Verdict fields from model output; `error` is set where the text is not a verdict.

    A verdict is one JSON object, and nothing else, with a list of active
    providers, or a text that names them. Rows in error keep the text as it came in `raw_received`. The JSON
    parser stops after the first value, so the text is parsed as the first entry
    of an array whose second one must be the end mark.
    """
    array = F.concat(F.lit("["), strip_fences(F.col(text)), F.lit(f',"{END_MARK}"]'))
    parsed = evaluate_once(df, F.try_parse_json(array), "_v")
    fields = {"score": ("threat_score", "int"), "is_malicious": ("is_malicious", "boolean"),
              "verdict_en": ("verdict_en", "string"), "analysis_pl": ("analysis_pl", "string"),
              "scoring_rationale": ("scoring_rationale", "string"),
              "active_providers": ("active_providers", "array<string>")}
    opened = parsed.withColumns({
        **{name: F.try_variant_get("_v", f"$[0].{key}", kind) for name, (key, kind) in fields.items()},
        "_end": F.try_variant_get("_v", "$[1]", "string"),
        "_listed": F.try_variant_get("_v", "$[0].active_providers", "string")}).drop("_v")
    # providers named in one text instead of a list; an object is neither
    named = F.filter(F.array(*map(F.lit, PROVIDER_NAMES)), lambda key: F.contains(F.col("_listed"), key))
    as_text = F.when(~F.col("_listed").rlike(r"^[\[{]"), named)
    opened = opened.withColumn("active_providers", F.coalesce("active_providers", as_text)).drop("_listed")
    good = F.col("active_providers").isNotNull() & F.col("_end").eqNullSafe(F.lit(END_MARK))
    checked = opened.withColumn("error", F.when(~good, "Parsing failed")).drop("_end")
    return checked.withColumns({
        **{name: F.when(F.col("error").isNull(), F.col(name)) for name in fields},
        "raw_received": F.when(F.col("error").isNotNull(), F.col(text))}).drop(text)


def provider_details(verdicts: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per verdict and active provider that has a stored document: the newest one's id.

    VirusTotal is stored by address, the others by domain; unknown provider keys
    drop out. Only ids and dates of the archive are read and moved, no payloads.
    """
    name = F.coalesce(*[F.when(F.col("provider") == key, value) for key, value in PROVIDER_NAMES.items()])
    listed = (verdicts.filter("error IS NULL")
              .select("dns_query_id", "fqdn", "observable_ip",
                      F.explode(F.array_distinct("active_providers")).alias("provider"))
              .withColumn("source_provider", name).filter("source_provider IS NOT NULL")
              .select("dns_query_id", "source_provider",
                      F.when(F.col("provider") == "virustotal", F.col("observable_ip"))
                      .otherwise(F.col("fqdn")).alias("resource")))
    keys = ("resource", "source_provider")
    stored = latest_raw(raw.select(*keys, "scan_date", "doc_id"), keys).select(*keys, "doc_id")
    return spread_join(listed, stored, list(keys))


def build_alerts(verdicts: DataFrame, product: str = "DNS watch") -> DataFrame:
    """Alert records for malicious and review verdicts, styled by severity.

    Expects dns_query_id, fqdn, observable_ip, score, is_malicious and the
    verdict texts; `providers` is the list of sources to show.
    """
    styled = pick_severity(needs_alert(verdicts), product=product)
    return styled.select(
        "dns_query_id", "observable_ip", "fqdn", "score",
        F.concat(F.col("score").cast("string"), F.lit("/5")).alias("score_text"),
        "accent", "header_text", "badge", "providers", "verdict_en", "analysis_pl", "scoring_rationale",
        F.concat(F.lit("https://rdap.arin.net/registry/ip/"), "observable_ip").alias("details_url"))
