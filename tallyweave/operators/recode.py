"""Recoding of variables from code to label by a dictionary table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.columns import quoted
from tallyweave.functions.expressions import as_code
from tallyweave.operators.bounded import proven_small
from tallyweave.operators.geo import geographic_lookup, geographic_recode, lookup_levels
from tallyweave.sources.workspace import stored

LOG_SCHEMA = (
    "table_name string, operation_type string, source_column string, target_column string, "
    "mappings_applied long, success boolean, error_message string"
)


@dataclass(frozen=True)
class Recoding:
    variable: str
    target: str
    codes: int


def usable_mappings(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows flagged for recoding whose variable, code and label are known."""
    return dictionary.filter(
        (F.upper("requiere_recodificacion") == "SI")
        & F.col("variable_codigo").isNotNull()
        & F.col("codigo").isNotNull()
        & F.col("etiqueta").isNotNull()
    )


def mappings_for(dictionary: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per variable (of the table's columns) and code; of several labels the greatest wins."""
    usable = usable_mappings(dictionary)
    if columns is not None:
        usable = usable.filter(F.col("variable_codigo").isin(columns))
    return (
        usable.groupBy("variable_codigo", as_code("codigo").alias("codigo"))
        .agg(
            F.max("etiqueta").alias("etiqueta"),
            F.max("campo").alias("campo"),
            F.count("*").alias("filas"),
        )
    )


def recodings(mappings: DataFrame) -> list[Recoding]:
    """Variables to recode with their output column; at most one per column of the table."""
    rows = mappings.groupBy("variable_codigo").agg(
        F.max(F.when(F.col("campo") != "", F.col("campo"))).alias("campo"),
        F.sum("filas").alias("filas"),
    )
    return [
        Recoding(r.variable_codigo, r.campo or f"{r.variable_codigo}_recoded", r.filas)
        for r in sorted(rows.collect(), key=lambda r: r.variable_codigo)
    ]


def recode_by_join(df: DataFrame, pairs: DataFrame, variable: str, target: str) -> DataFrame:
    """Label of the code; a code without a label stays as it is, null stays null."""
    code = as_code(variable)
    labels = pairs.select(F.col("codigo").alias("__code"), F.col("etiqueta").alias("__label"))
    kept = [c for c in df.columns if c != target]
    return df.join(labels, code == F.col("__code"), "left").select(
        *[df[quoted(c)] for c in kept], F.coalesce(F.col("__label"), code).alias(target)
    )


def _with_targets(df: DataFrame, columns: list[str], targets: dict[str, str]) -> DataFrame:
    """The columns with those of ``targets`` (name to the column that holds it) in place of old ones."""
    kept = [quoted(c) for c in columns if c not in targets]
    return df.select(*kept, *[F.col(value).alias(name) for name, value in targets.items()])


def recode_by_broadcast(df: DataFrame, mappings: DataFrame, done: Sequence[Recoding]) -> DataFrame:
    """All variables in one pass over the rows: a hash table a variable, no shuffle of ``df``.

    ``mappings`` is broadcast and has to be proven small. Every code is read as it was before
    the recoding; of two variables with one target the later name wins.
    """
    out = df
    for i, r in enumerate(done):
        pairs = mappings.filter(F.col("variable_codigo") == r.variable)
        out = recode_by_join(out, F.broadcast(pairs), r.variable, f"__label{i}")
    return _with_targets(out, df.columns, {r.target: f"__label{i}" for i, r in enumerate(done)})


def recode_unpivoted(df: DataFrame, mappings: DataFrame, done: Sequence[Recoding]) -> DataFrame:
    """The same rows by one join for any number of variables, for a dictionary of any size.

    The codes of all variables are unpivoted to (row, variable, code), meet the dictionary once and
    are folded back to a row of labels. Rows are numbered in a written table, so that a
    number stays the same whatever is computed again.
    """
    if not done:
        return df
    numbered = stored(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    cells = numbered.select(
        "__row",
        F.explode(
            F.array(*[F.struct(F.lit(r.variable).alias("variable_codigo"), as_code(r.variable).alias("codigo")) for r in done])
        ).alias("cell"),
    ).select("__row", "cell.*")
    found = cells.filter(F.col("codigo").isNotNull()).join(
        mappings.select("variable_codigo", "codigo", "etiqueta"), ["variable_codigo", "codigo"]
    )
    labels = found.groupBy("__row").agg(
        *[
            F.max(F.when(F.col("variable_codigo") == r.variable, F.col("etiqueta"))).alias(f"__label{i}")
            for i, r in enumerate(done)
        ]
    )
    out = numbered.join(labels, ["__row"], "left")
    for i, r in enumerate(done):
        out = out.withColumn(f"__label{i}", F.coalesce(F.col(f"__label{i}"), as_code(r.variable)))
    return _with_targets(out, df.columns, {r.target: f"__label{i}" for i, r in enumerate(done)})


def recoded(df: DataFrame, mappings: DataFrame, done: Sequence[Recoding], small: bool) -> DataFrame:
    return (recode_by_broadcast if small else recode_unpivoted)(df, mappings, done)


def recode_table(df: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, list[Recoding]]:
    """Recode every flagged variable the table has; the dictionary is evaluated once, into a written table."""
    mappings = stored(mappings_for(dictionary, df.columns), "mappings")
    done = recodings(mappings)
    return recoded(df, mappings, done, proven_small(mappings)), done


def recode_all(
    tables: Mapping[str, DataFrame], dictionaries: Mapping[str, DataFrame]
) -> tuple[dict[str, DataFrame], list[tuple]]:
    """Recode and locate every data table; returns the tables and the operation log rows."""
    levels = lookup_levels(geographic_lookup(dictionaries))
    known = {}
    for chosen in sorted({presets.RECODE_DICTIONARY.get(name) for name in tables} & set(dictionaries)):
        users = [df.columns for name, df in tables.items() if presets.RECODE_DICTIONARY.get(name) == chosen]
        mappings = stored(mappings_for(dictionaries[chosen], sorted({c for columns in users for c in columns})), "mappings")
        known[chosen] = (mappings, recodings(mappings), proven_small(mappings))
    out, log = {}, []
    for name, df in tables.items():
        if name.startswith(presets.DICTIONARY_PREFIX):
            out[name] = df
            continue
        if presets.RECODE_DICTIONARY.get(name) in known:
            mappings, every, small = known[presets.RECODE_DICTIONARY[name]]
            done = [r for r in every if r.variable in df.columns]
            df = recoded(df, mappings, done, small)
            log += [(name, "variable_recoding", r.variable, r.target, r.codes, True, None) for r in done]
        columns = [c for c in presets.GEO_COLUMNS_BY_TABLE.get(name, []) if c in df.columns]
        out[name] = geographic_recode(df, name, levels)
        added = len(out[name].columns) - len(df.columns)
        log.append((name, "geographic_recoding", ",".join(columns), "geography", added, True, None))
    return out, log
