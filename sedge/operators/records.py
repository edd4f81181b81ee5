"""Normalised extraction records: fixed schema, status, packed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a normalised record.
RECORD = (
    "struct<source_file:string,title:string,authors:array<string>,doi:string,is_perovskite_synthesis:boolean,material:string,precursors:array<struct<name:string,concentration:string>>,synthesis_method:string,"
    "process_conditions:struct<temperature:string,duration:string,atmosphere:string,annealing:string>,substrate:string,characterization:struct<xrd:string,sem:string,bandgap:string,film_thickness:string>,"
    "device_performance:struct<pce:string,voc:string,jsc:string,ff:string>,key_findings:string>"
)
TEXTS = ("title", "doi", "material", "synthesis_method", "substrate", "key_findings")
GROUPS = {"process_conditions": ("temperature", "duration", "atmosphere", "annealing"), "characterization": ("xrd", "sem", "bandgap", "film_thickness"), "device_performance": ("pce", "voc", "jsc", "ff")}


def leaf(raw: Column, path: str) -> Column:
    """A leaf of a raw record: the value of {value, source}, else the plain value."""
    return F.coalesce(F.try_variant_get(raw, f"$.{path}.value", "string"), F.try_variant_get(raw, f"$.{path}", "string"))


def clean_precursors(items: Column) -> Column:
    """Items with a name or a concentration; an empty array where there are none."""
    return F.coalesce(F.filter(items, lambda x: F.coalesce(x["name"], x["concentration"]).isNotNull()), F.array().cast("array<struct<name:string,concentration:string>>"))


def status(keys: Column) -> Column:
    """not_perovskite for a record with no more than its name and flag, extraction_failed, or null for a full one."""
    minimal = F.size(F.array_except(keys, F.array(F.lit("filename"), F.lit("is_perovskite_synthesis")))) == 0
    failed = F.array_contains(keys, "error") | (F.array_contains(keys, "raw_output") & ~F.array_contains(keys, "title"))
    return F.when(minimal, "not_perovskite").when(failed, "extraction_failed")


def normalise(raw_json: Column, source_file: Column) -> Column:
    """A raw JSON record as a struct of the fixed schema: unknown keys dropped, missing ones null or empty."""
    v = F.try_parse_json(raw_json)
    keys = F.json_object_keys(raw_json)
    full = status(keys).isNull()
    names = F.from_json(F.coalesce(F.get_json_object(raw_json, "$.precursors.value"), F.get_json_object(raw_json, "$.precursors")), "array<struct<name:string,concentration:string>>")

    def only(c: Column) -> Column:
        return F.when(full, c)

    fields = [source_file.alias("source_file"), F.coalesce(F.try_variant_get(v, "$.is_perovskite_synthesis", "boolean"), F.when(status(keys) == "not_perovskite", False)).alias("is_perovskite_synthesis")]
    fields += [only(leaf(v, p)).alias(p) for p in TEXTS]
    fields += [clean_precursors(only(names)).alias("precursors")]
    fields += [F.struct(*(only(leaf(v, f"{g}.{p}")).alias(p) for p in ps)).alias(g) for g, ps in GROUPS.items()]
    fields += [F.struct(full.alias("extraction_complete"), status(keys).alias("reason")).alias("_meta")]
    return F.struct(*fields)
