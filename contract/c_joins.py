"""Joins and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import CANTON_LOOKUP, GEO_LOOKUP, dictionaries, sub, view
from contract.registry import query, table
from tallyweave.functions.columns import quoted
from tallyweave.operators import geo, joins
from tallyweave.operators.bounded import broadcast_small


def _person_household(spark, sf):
    return joins.join_keeping(
        view(spark, sf, "poblacion"),
        view(spark, sf, "hogar"),
        {"ID_VIV": "ID_VIV", "ID_HOG": "ID_HOG"},
        ["ID_VIV AS idVivienda", "ID_HOG AS idHogar", "ID_PER AS idPersona", "P03 AS edad", "I01 AS provinciaCodigo"],
        ["H01 AS numeroDormitorios", "H1303 AS totalPersonasHogar", "I01 AS provinciaHogar"],
    )


C01_SQL = f"""SELECT p.ID_VIV AS idVivienda, p.ID_HOG AS idHogar, p.ID_PER AS idPersona, p.P03 AS edad,
    p.I01 AS provinciaCodigo, h.H01 AS numeroDormitorios, h.H1303 AS totalPersonasHogar, h.I01 AS provinciaHogar
    FROM {sub('poblacion')} p JOIN {sub('hogar')} h ON p.ID_VIV = h.ID_VIV AND p.ID_HOG = h.ID_HOG"""


@query("c01_person_household", C01_SQL)
def c01(spark, sf):
    return _person_household(spark, sf)


@query(
    "c02_with_dwelling",
    f"""SELECT r.*, v.V01 AS tipoViviendaCodigo, v.V0201R AS materialParedesCodigo
    FROM ({C01_SQL}) r JOIN {sub('vivienda')} v ON r.idVivienda = v.ID_VIV""",
)
def c02(spark, sf):
    left = _person_household(spark, sf)
    return joins.join_keeping(
        left,
        view(spark, sf, "vivienda"),
        {"idVivienda": "ID_VIV"},
        [quoted(c) for c in left.columns],
        ["V01 AS tipoViviendaCodigo", "V0201R AS materialParedesCodigo"],
    )


@query(
    "c03_nullable_keys",
    f"""SELECT p.id_persona, p.id_vivienda, p.id_hogar, v.vi01 FROM {sub('enemdu_personas')} p
    JOIN {sub('enemdu_vivienda')} v ON p.id_vivienda = v.id_vivienda AND p.id_hogar = v.id_hogar""",
)
def c03(spark, sf):
    return joins.join_keeping(
        view(spark, sf, "enemdu_personas"),
        view(spark, sf, "enemdu_vivienda"),
        {"id_vivienda": "id_vivienda", "id_hogar": "id_hogar"},
        ["id_persona", "id_vivienda", "id_hogar"],
        ["vi01"],
    )


@query("c04_parents_onto_children", f"SELECT * FROM {GEO_LOOKUP}")
def c04(spark, sf):
    d = dictionaries(spark, sf)
    return geo.with_parents(
        geo.parish_names(d["dict_parroquia"]), geo.canton_names(d["dict_canton"]), geo.province_names(d["dict_provincia"])
    )


ENRICHED_SQL = f"""SELECT v.*, lpad(v.I01, 2, '0') AS codigo_provincia_2d_homo, lpad(v.CANTON, 4, '0') AS codigo_canton_4d_homo,
    k.* FROM {sub('vivienda')} v LEFT JOIN {CANTON_LOOKUP} k ON lpad(v.CANTON, 4, '0') = k.codigo_canton_4d"""


@query("c05_lookup_join", ENRICHED_SQL)
def c05(spark, sf):
    levels = geo.lookup_levels(geo.geographic_lookup(dictionaries(spark, sf)))
    return geo.enriched(geo.homologated_table(view(spark, sf, "vivienda"), "vivienda"), levels)


@query(
    "c06_fan_out",
    f"SELECT (SELECT count(*) FROM customer) AS rows_before, (SELECT count(*) FROM ({ENRICHED_SQL})) AS rows_after, "
    f"(SELECT count(*) FROM ({ENRICHED_SQL})) <> (SELECT count(*) FROM customer) AS changed",
)
def c06(spark, sf):
    before = view(spark, sf, "vivienda")
    levels = geo.lookup_levels(geo.geographic_lookup(dictionaries(spark, sf)))
    return joins.fan_out(before, geo.enriched(geo.homologated_table(before, "vivienda"), levels))


def _audit_sql(name, side):
    return (
        f"SELECT '{side}' AS side, count(*) AS rows, count(DISTINCT (id_vivienda, id_hogar)) AS distinct_keys, "
        f"count(*) FILTER (WHERE id_vivienda IS NULL OR id_hogar IS NULL) AS null_keys FROM {sub(name)}"
    )


@query("c07_key_audit", _audit_sql("enemdu_personas", "left") + " UNION ALL " + _audit_sql("enemdu_vivienda", "right"))
def c07(spark, sf):
    return joins.join_key_audit(
        view(spark, sf, "enemdu_personas"), view(spark, sf, "enemdu_vivienda"), ["id_vivienda", "id_hogar"]
    )


@query(
    "c08_broadcast_by_size",
    "SELECT n_name, count(*) AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def c08(spark, sf):
    nation = broadcast_small(table(spark, sf, "nation"))
    joined = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("rows"))
