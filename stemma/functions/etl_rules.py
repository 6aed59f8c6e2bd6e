"""Job definitions: pick the jobs out of a JSON text, normalise fields, derive edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.text import etl_table_ref, first_filled, strip
from stemma.schemas import EDGE_STRUCT

# Keys that may hold the job list, in order of preference.
JOB_LIST_KEYS = ("etl_jobs", "jobs", "processes")

_NO_TEXTS = "array<string>"


def _list_of(doc: Column, path: str) -> Column:
    """The array at ``path`` as variants; null when it is missing or something else."""
    found = F.try_variant_get(doc, path, "variant")
    is_list = F.startswith(F.schema_of_variant(found), F.lit("ARRAY"))
    return F.when(is_list, F.try_variant_get(doc, path, "array<variant>"))


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def jobs_of(doc: Column) -> Column:
    """Filled job objects of one parsed file: a list root, a list under a known key, or the root itself."""
    candidates = [_list_of(doc, "$")] + [_list_of(doc, f"$.{k}") for k in JOB_LIST_KEYS]
    whole = F.when(is_object(doc), F.array(doc))
    return F.filter(F.coalesce(*candidates, whole), lambda v: is_object(v) & (F.schema_of_variant(v) != "OBJECT<>"))


def _text(job: Column, field: str) -> Column:
    return F.try_variant_get(job, f"$.{field}", "string")


def _texts(job: Column, field: str) -> Column:
    """A list of texts; a single text counts as a list of one."""
    one = F.when(_text(job, field) != "", F.array(_text(job, field)))
    return F.coalesce(
        F.transform(_list_of(job, f"$.{field}"), lambda x: F.try_variant_get(x, "$", "string")),
        one,
        F.array().cast(_NO_TEXTS),
    )


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != "")


def normalize_dependency(text: Column, etl: Column, name: Column) -> Column:
    """'etl:<job>'; a text that already has the prefix stays, an empty one gives ''."""
    stripped = strip(F.coalesce(text, F.lit("")))
    prefixed = F.when(F.startswith(stripped, F.lit("etl:")) | (stripped == ""), stripped).otherwise(
        F.concat(F.lit("etl:"), stripped)
    )
    named = first_filled(etl, name)
    return F.when(named.isNotNull(), F.concat(F.lit("etl:"), named)).otherwise(prefixed)


def _dependency_id(item: Column) -> Column:
    """Dependency id of one list item, a text or an object with 'etl' or 'name'."""
    return normalize_dependency(
        F.try_variant_get(item, "$", "string"),
        F.when(is_object(item), _text(item, "etl")),
        F.when(is_object(item), _text(item, "name")),
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def job_fields(job: Column, path: Column, default_schema: str = "public") -> list[Column]:
    """Normalised fields of one job object."""

    def tables(field: str) -> Column:
        refs = F.transform(_filled(_texts(job, field)), lambda t: etl_table_ref(t, default_schema))
        return _filled(refs)

    dependencies = _list_of(job, "$.dependencies")
    return [
        F.coalesce(first_filled(_text(job, "name")), file_stem(path)).alias("name"),
        F.coalesce(_text(job, "description"), F.lit("")).alias("description"),
        F.coalesce(_text(job, "owner"), F.lit("")).alias("owner"),
        F.coalesce(_text(job, "schedule"), F.lit("")).alias("schedule"),
        tables("sources").alias("sources"),
        tables("targets").alias("targets"),
        _texts(job, "transformations").alias("transformations"),
        _texts(job, "dependencies").alias("dependencies"),
        _filled(
            F.coalesce(
                F.transform(dependencies, _dependency_id),
                F.transform(_texts(job, "dependencies"), lambda t: normalize_dependency(t, F.lit(None), F.lit(None))),
            )
        ).alias("dependency_ids"),
    ]


def job_documentation() -> Column:
    """Sentences about the job whose fields are the columns of the row."""

    def listed(field: str, title: str, separator: str) -> Column:
        return F.when(
            F.size(field) > 0,
            F.concat(F.lit(title), F.array_join(field, separator), F.lit(".")),
        )

    return strip(
        F.concat_ws(
            " ",
            F.concat(F.lit("ETL process "), "name", F.lit(".")),
            first_filled(F.col("description")),
            listed("sources", "Reads from: ", ", "),
            listed("targets", "Writes to: ", ", "),
            listed("transformations", "Transformations: ", "; "),
            F.concat(F.lit("Schedule: "), first_filled(F.col("schedule")), F.lit(".")),
        )
    )


def job_edges(asset_id: Column) -> Column:
    """Edges of the job: sources feed it, it feeds targets, dependencies precede it."""

    def edge(source: Column, target: Column, kind: str) -> Column:
        return F.struct(
            source.alias("source"), target.alias("target"), F.lit(kind).alias("relationship_type")
        )

    return F.concat(
        F.transform("sources", lambda s: edge(s, asset_id, "etl_source")),
        F.transform("targets", lambda t: edge(asset_id, t, "etl_target")),
        F.transform("dependency_ids", lambda d: edge(d, asset_id, "etl_depends_on")),
    ).cast(f"array<{EDGE_STRUCT.simpleString()}>")
