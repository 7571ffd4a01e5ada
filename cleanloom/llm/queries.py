"""The queries of this subpackage, with production parameters, over whole tables; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cleanloom.functions.session import table
from cleanloom.llm.addresses import same_buildings
from cleanloom.llm.linkage import match_people
from cleanloom.llm.mixing import mix_sources, mixture_report
from cleanloom.llm.names import variant_names
from cleanloom.llm.packing import container_report, fill_containers
from cleanloom.llm.places import map_places
from cleanloom.llm.splitting import split_texts
from cleanloom.llm.survivors import survivor_records, survivors

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return same_buildings(table(spark, d, "source_records"), table(spark, d, "place_reference"), table(spark, d, "place_aliases"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return map_places(table(spark, d, "source_records"), table(spark, d, "place_reference"), table(spark, d, "place_aliases"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "duplicate_groups"), table(spark, d, "source_records"), table(spark, d, "source_registry"), table(spark, d, "place_reference"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor_records(p4_survivors(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_names(table(spark, d, "source_records"), table(spark, d, "corruption_events"), table(spark, d, "given_name_forms"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_people(*(table(spark, d, t) for t in ("source_records", "partner_records", "place_reference", "place_aliases", "given_name_forms")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("source_record_id_a", "source_record_id_b")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), table(spark, d, "size_limits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_report(p8_containers(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), table(spark, d, "size_limits"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p3_found, p4_survivors, p4_found, p6_found, p7_matches, p7_found, p8_containers, p8_fill, p9_mixture, p9_shares, p10_pieces)}


def oracle_sql() -> dict[str, str]:
    return {}
