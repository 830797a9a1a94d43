"""Declared tables as checks: every violated rule of every row, in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """What a table demands: column lengths, columns without NULL, decimals (digits, places), references (column to
    dictionary and its key), and keys that occur once."""
    lengths: dict[str, int] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    decimals: dict[str, tuple[int, int]] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()


# The declared tables.
TABLES = {
    "dic_indicator_types": Table({"name": 20}, ("id", "name"), unique=(("id",), ("name",))),
    "dic_source_providers": Table({"name": 50}, ("id", "name"), unique=(("id",), ("name",))),
    "dic_threat_levels": Table({"description": 100, "action_recommended": 50}, ("score", "description"), unique=(("score",),)),
    "dns_queries": Table({"query_type": 10, "record_type": 10, "domain": 255, "source_ip": 45, "response_ip": 45},
                         ("timestamp", "query_type", "domain", "source_ip")),
    "ai_analysis_results": Table({"threat_label": 50}, ("threat_score",), {"confidence_score": (5, 2)},
                                 {"threat_score": ("dic_threat_levels", "score")}),
    "threat_indicators": Table({}, ("dns_query_id", "type_id", "analysis_result_id", "last_scan"),
                               references={"type_id": ("dic_indicator_types", "id")},
                               unique=(("dns_query_id", "analysis_result_id", "last_scan"),)),
    "threat_indicator_details": Table({"mongo_ref_id": 50, "raw_response_hash": 64}, ("indicator_id", "source_id"),
                                      references={"source_id": ("dic_source_providers", "id")},
                                      unique=(("indicator_id", "source_id"),)),
    "network_events": Table({"source_ip": 45, "dest_ip": 45, "protocol": 10, "application_protocol": 20, "http_method": 10,
                             "event_type": 50, "signature_name": 255, "action_taken": 20},
                            ("timestamp", "source_ip", "dest_ip")),
}


def _own_rules(df: DataFrame, table: Table) -> list[tuple[str, Column]]:
    """Rules that a row alone can break; columns that `df` lacks are NULL."""
    rules = [(f"{c} is missing", F.col(c).isNull() if c in df.columns else F.lit(True)) for c in table.required]
    rules += [(f"{c} has more than {n} characters", F.char_length(F.col(c).cast("string")) > n)
              for c, n in table.lengths.items() if c in df.columns]
    for c, (digits, places) in table.decimals.items():
        if c in df.columns:
            limit = 10 ** (digits - places)
            # what rounds up to the limit does not fit either
            rules.append((f"{c} is out of range", F.abs(F.round(F.col(c).cast("decimal(38, 10)"), places)) >= limit))
    return rules


def checked(df: DataFrame, name: str, dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows with `violations`, the names of all rules they break, in order (empty: none).

    Values are compared with a dictionary by a join on its distinct keys; the planner broadcasts
    it by its size. A dictionary that is not given is not checked. Keys that must be unique
    are counted with map-side combine, and every row of a repeated key breaks the rule.
    """
    table, broken = TABLES[name], []
    rows = df
    for i, (column, (dictionary, key)) in enumerate(table.references.items()):
        if dictionaries and dictionary in dictionaries and column in df.columns:
            known = dictionaries[dictionary].select(F.col(key).alias(column), F.lit(True).alias(f"_known{i}")).distinct()
            rows = rows.join(known, column, "left")
            unknown = F.col(column).isNotNull() & F.col(f"_known{i}").isNull()
            broken.append((f"{column} is not in {dictionary}", unknown))
    for i, keys in enumerate(table.unique):
        if all(k in df.columns for k in keys):
            often = df.groupBy(*keys).agg(F.count("*").alias(f"_times{i}")).filter(f"_times{i} > 1")
            rows = rows.join(often, list(keys), "left")
            broken.append((f"{', '.join(keys)} is not unique", F.col(f"_times{i}").isNotNull()))
    rules = [F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in [*_own_rules(df, table), *broken]]
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return rows.select(*df.columns, found.alias("violations"))


def split_valid(df: DataFrame, name: str, dictionaries: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that the table takes, and those that it refuses with their `violations`."""
    rows = checked(df, name, dictionaries)
    return rows.filter(F.size("violations") == 0).drop("violations"), rows.filter(F.size("violations") > 0)


def violations_by_rule(tables: dict[str, DataFrame], dictionaries: dict[str, DataFrame]) -> DataFrame:
    """`table_name`, `rule`, `rows`: how many rows of each table break each rule."""
    out = None
    for name, df in tables.items():
        found = checked(df, name, dictionaries).select(F.explode("violations").alias("rule"))
        counted = found.groupBy("rule").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rule", "rows")
        out = counted if out is None else out.unionAll(counted)
    return out
