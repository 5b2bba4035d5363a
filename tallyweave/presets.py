"""Fixed values of the census and labour-survey domain.

Every operator takes these as parameters; this module only holds the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: table names -------------------------------------------------

DATA_TABLES = ["poblacion", "hogar", "vivienda", "enemdu_personas", "enemdu_vivienda"]
REQUIRED_TABLES = ["poblacion", "hogar", "vivienda"]
DICTIONARY_PREFIX = "dict_"

# Dictionary file name -> table key
DICTIONARY_FILES = {
    "ZR_Sftp_DICCIONARIO_PROVINCIA_2022": "dict_provincia",
    "ZR_Sftp_DICCIONARIO_CANTON_2022": "dict_canton",
    "ZR_Sftp_DICCIONARIO_PARROQUIA_2022": "dict_parroquia",
    "ZR_Sftp_DICCIONARIO_CENSO_2022": "dict_censo",
    "ZR_Sftp_DICCIONARIO_ENEMDU_2022": "dict_enemdu",
}

# Data table -> recoding dictionary
RECODE_DICTIONARY = {
    "poblacion": "dict_censo",
    "hogar": "dict_censo",
    "vivienda": "dict_censo",
    "enemdu_personas": "dict_enemdu",
    "enemdu_vivienda": "dict_enemdu",
}

# --- Fixed values: ingestion control table ---------------------------------------

CONTROL_REQUIRED = [
    "id_ingesta",
    "estado",
    "nombre_archivo",
    "nombre_tabla",
    "path_origen",
    "path_destino",
]
CONTROL_DEFAULTS = {"delimitador": ",", "grupo_ingesta": "default", "orden_grupo": 1}

# --- Fixed values: geography -----------------------------------------------------

# column -> (homologated column, code width)
GEO_COLUMNS = {
    "I01": ("codigo_provincia_2d_homo", 2),
    "CANTON": ("codigo_canton_4d_homo", 4),
    "ciudad": ("codigo_parroquia_6d_homo", 6),
}
GEO_COLUMNS_BY_TABLE = {
    "poblacion": ["I01", "CANTON"],
    "hogar": ["I01", "CANTON"],
    "vivienda": ["I01", "CANTON"],
    "enemdu_personas": ["ciudad"],
    "enemdu_vivienda": ["ciudad"],
}
PROVINCE_CODE_COLUMNS = [
    "codigo_provincia_2d",
    "codigo_provincia_2d_homo",
    "codigo_provincia_derivado",
    "I01",
]
PROVINCE_NAME_COLUMNS = ["provinciaNombre", "provincia_nombre"]
PROVINCE_WINDOW_COLUMNS = [
    "codigo_provincia_2d",
    "codigo_provincia_2d_homo",
    "I01",
    "provincia_codigo",
]
PROVINCE_COVERAGE_COLUMNS = ["I01", "codigo_provincia_2d", "codigo_provincia_2d_homo"]

PROVINCE_CODES = [f"{n:02d}" for n in range(1, 25)]
MIN_PROVINCES = 20

# Provinces 10, 11 and 17 are in no list and so fall into OTRAS.
REGION_BY_PROVINCE = {
    "SIERRA": ["01", "02", "03", "04", "05", "06", "18"],
    "COSTA": ["07", "08", "09", "12", "13", "21", "23", "24"],
    "AMAZONIA": ["14", "15", "16", "19", "22"],
    "GALAPAGOS": ["20"],
}
REGION_DEFAULT = "OTRAS"
REGION_BY_NAME = {
    "CAPITAL": ["quito", "pichincha"],
    "COMERCIAL": ["guayas", "guayaquil"],
    "PATRIMONIAL": ["azuay", "cuenca"],
}
REGION_BY_NAME_DEFAULT = "OTRAS_PROVINCIAS"
DENSITY_BASE = 100000

# --- Fixed values: demographic rules ---------------------------------------------

# label, exclusive upper age
AGE_DETAIL = [
    ("PRIMERA_INFANCIA", 5),
    ("INFANCIA", 12),
    ("ADOLESCENCIA", 18),
    ("JUVENTUD", 27),
    ("ADULTEZ", 60),
]
AGE_DETAIL_DEFAULT = "ADULTO_MAYOR"
AGE_ECONOMIC = [("DEPENDIENTE_MENOR", 15), ("POBLACION_ACTIVA", 65)]
AGE_ECONOMIC_DEFAULT = "DEPENDIENTE_MAYOR"
WORKING_AGE = (15, 65)

# age and sex columns by table; other tables use the first pair
AGE_SEX_COLUMNS = ("P03", "P02")
AGE_SEX_COLUMNS_BY_TABLE = {"enemdu_personas": ("p03", "p02")}

# label, inclusive lower and exclusive upper age
AGE_BANDS = [
    ("MENOR_15", 0, 15),
    ("JOVEN_15_24", 15, 25),
    ("ADULTO_25_34", 25, 35),
    ("ADULTO_35_49", 35, 50),
    ("ADULTO_50_64", 50, 65),
    ("ADULTO_MAYOR_65", 65, 120),
]
ACTIVE_AGE_RANGE = (15, 64)
INCOME_THRESHOLDS = {"bajo": 400.0, "medio": 800.0, "alto": 1500.0}

SEX_CODES = {"1": "HOMBRE", "2": "MUJER"}
SEX_DEFAULT = "NO_ESPECIFICADO"

EDUCATION_COLUMN_TERMS = ["educacion", "instruccion", "escolar"]
HIGHER_EDUCATION = ["superior", "universitario", "post-grado"]
BASIC_EDUCATION = ["secundaria", "bachillerato"]
EDUCATION_LEVELS = [
    (["analfabet", "ninguno"], 0),
    (["primaria"], 1),
    (["secundaria", "bachillerato"], 2),
    (["superior", "universitario"], 3),
    (["post-grado", "maestr", "doctor"], 4),
]
EDUCATION_LEVEL_DEFAULT = 1
EDUCATION_LEVEL_MAX = 4

EMPLOYMENT_COLUMN_TERMS = ["empleo", "ocupacion", "trabajo"]
NOT_EMPLOYED = ["desempleo", "inactiv", "no ocupa"]
OCCUPATION_COLUMN_TERMS = ["ocupacion", "categoria", "empleo"]
FORMAL_EMPLOYMENT = ["empleado", "asalariado"]
KINSHIP_COLUMN_TERMS = ["parentesco"]
HOUSEHOLD_HEAD = ["jefe", "representante"]
INCOME_COLUMN_TERMS = ["ingr"]
SUFFICIENT_INCOME = 400

INDEX_CUTS = (0.7, 0.4)
VULNERABILITY_LABELS = ("ALTA", "MEDIA", "BAJA")
DEVELOPMENT_LABELS = ("ALTO", "MEDIO", "BAJO")

# --- Fixed values: feature catalog -----------------------------------------------
# name, type, source columns, description, method, data type

FEATURES = [
    ("grupo_edad_detallado", "demographic", ["P03"], "Detailed age group", "age_classification", "string"),
    ("grupo_edad_economico", "demographic", ["P03"], "Economic age group", "economic_age_classification", "string"),
    ("es_dependiente_demografico", "demographic", ["P03"], "Outside working age", "age_threshold", "integer"),
    ("es_poblacion_activa", "demographic", ["P03"], "Within working age", "age_threshold", "integer"),
    ("sexo_descripcion", "demographic", ["P02"], "Sex label", "categorical_mapping", "string"),
    ("es_mujer", "demographic", ["P02"], "Female flag", "binary_encoding", "integer"),
    ("es_hombre", "demographic", ["P02"], "Male flag", "binary_encoding", "integer"),
    ("tiene_educacion_superior", "demographic", ["educacion"], "Higher education flag", "regex_classification", "integer"),
    ("completo_educacion_basica", "demographic", ["educacion"], "Basic education flag", "regex_classification", "integer"),
    ("nivel_educativo_numerico", "demographic", ["educacion"], "Ordinal education level", "ordinal_encoding", "integer"),
    ("poblacion_total_provincia", "distributed_aggregate", ["I01"], "Rows per province", "distributed_count", "long"),
    ("densidad_relativa_provincia", "distributed_aggregate", ["I01"], "Rows per province over 100000", "distributed_normalization", "double"),
    ("ranking_provincial", "distributed_aggregate", ["I01"], "Rank of the province by rows", "distributed_ranking", "integer"),
    ("percentil_poblacional", "distributed_aggregate", ["I01"], "Hundredth of rows ordered by province size", "distributed_percentile", "integer"),
    ("tamaño_hogar_calculado", "distributed_aggregate", ["ID_VIV", "ID_HOG"], "Persons per household", "household_count", "long"),
    ("edad_promedio_hogar", "distributed_aggregate", ["ID_VIV", "ID_HOG", "P03"], "Mean age in the household", "household_average", "double"),
    ("edad_maxima_hogar", "distributed_aggregate", ["ID_VIV", "ID_HOG", "P03"], "Greatest age in the household", "household_max", "double"),
    ("edad_minima_hogar", "distributed_aggregate", ["ID_VIV", "ID_HOG", "P03"], "Least age in the household", "household_min", "double"),
    ("dependientes_hogar", "distributed_aggregate", ["ID_VIV", "ID_HOG", "P03"], "Dependants in the household", "household_conditional_sum", "long"),
    ("ratio_dependencia_hogar", "distributed_aggregate", ["ID_VIV", "ID_HOG", "P03"], "Dependants over persons", "household_ratio", "double"),
    ("indice_vulnerabilidad_compuesto", "composite_index", ["es_dependiente_demografico", "tiene_educacion_superior"], "Vulnerability index", "weighted_aggregation", "double"),
    ("categoria_vulnerabilidad", "composite_index", ["indice_vulnerabilidad_compuesto"], "Vulnerability category", "threshold_classification", "string"),
    ("indice_desarrollo_compuesto", "composite_index", ["nivel_educativo_numerico", "es_poblacion_activa", "es_urbano"], "Development index", "weighted_aggregation", "double"),
    ("categoria_desarrollo", "composite_index", ["indice_desarrollo_compuesto"], "Development category", "threshold_classification", "string"),
    ("es_urbano", "geographic", ["AUR"], "Urban flag", "binary_encoding", "integer"),
    ("region_geografica", "geographic", ["I01"], "Natural region", "categorical_mapping", "string"),
    ("region_especifica", "geographic", ["provinciaNombre"], "Region by province name", "regex_classification", "string"),
    ("target_vulnerabilidad_alta", "target_variable", ["categoria_vulnerabilidad"], "High vulnerability", "binary_classification_target", "double"),
    ("target_educacion_superior", "target_variable", ["tiene_educacion_superior"], "Higher education", "binary_classification_target", "double"),
    ("target_jefe_hogar", "target_variable", ["parentesco"], "Head of household", "binary_classification_target", "double"),
    ("target_area_urbana", "target_variable", ["es_urbano"], "Urban residence, census", "binary_classification_target", "double"),
    ("target_empleo_formal", "target_variable", ["ocupacion"], "Formal employment", "binary_classification_target", "double"),
    ("target_ingresos_suficientes", "target_variable", ["ingrl"], "Income at or above the threshold", "binary_classification_target", "double"),
    ("target_area_urbana_enemdu", "target_variable", ["es_urbano"], "Urban residence, survey", "binary_classification_target", "double"),
]

# question -> (feature types, least number of features)
QUESTION_COVERAGE = {
    "question_1_distributed_processing": (["distributed_aggregate"], 4),
    "question_2_automated_features": (["demographic", "composite_index"], 10),
    "question_3_ensemble_targets": (["target_variable"], 3),
}

# --- Fixed values: quality ---------------------------------------------------------

ID_COLUMNS = {
    "poblacion": ["ID_VIV", "ID_HOG", "ID_PER"],
    "hogar": ["ID_VIV", "ID_HOG"],
    "vivienda": ["ID_VIV"],
    "enemdu_personas": ["id_vivienda", "id_hogar", "id_persona"],
    "enemdu_vivienda": ["id_vivienda", "id_hogar"],
}
ID_PATTERNS = ["ID_", "id_", "_id", "codigo_"]
QUALITY_VALID_SCORE = 70.0
HIGH_NULL_PERCENT = 20
FEATURE_NAME_PREFIXES = ["grupo_", "es_", "indice_", "categoria_", "ratio_"]

# fractions, not percents
QUALITY_LIMITS = {"max_null": 0.05, "min_rows": 1000, "max_duplicate": 0.01}
QUALITY_PROFILES = {
    "development": {"max_null": 0.10, "min_rows": 100},
    "production": {"max_null": 0.02, "min_rows": 10000},
    "testing": {"max_null": 0.20, "min_rows": 10},
}


@dataclass(frozen=True)
class TableSchema:
    name: str
    keys: list[str]
    required: list[str]
    optional: list[str] = field(default_factory=list)
    partition: list[str] = field(default_factory=list)
    geographic: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)


SCHEMAS = {
    "poblacion": TableSchema(
        "poblacion",
        keys=["ID_VIV", "ID_HOG", "ID_PER"],
        required=["I01", "I02", "P02", "P03"],
        optional=["ESCOLA", "P27", "P28"],
        partition=["I01"],
        geographic=["I01", "CANTON"],
        categorical=["P02"],
        numeric=["P03", "ESCOLA"],
    ),
    "hogar": TableSchema(
        "hogar",
        keys=["ID_VIV", "ID_HOG"],
        required=["H01", "H1303"],
        optional=["H03", "H04", "H09"],
        partition=["I01"],
        geographic=["I01", "CANTON"],
        numeric=["H01", "H1303"],
    ),
    "vivienda": TableSchema(
        "vivienda",
        keys=["ID_VIV"],
        required=["V01", "V0201R"],
        optional=["V05", "V03", "V07"],
        partition=["I01"],
        geographic=["I01", "CANTON"],
        categorical=["V01", "V0201R"],
    ),
    "enemdu_personas": TableSchema(
        "enemdu_personas",
        keys=["id_vivienda", "id_hogar", "id_persona"],
        required=["p24", "p40", "p41", "ingrl"],
        optional=["p71b", "p03"],
        partition=["ciudad"],
        geographic=["ciudad"],
        numeric=["p24", "ingrl", "p71b", "p03"],
    ),
    "enemdu_vivienda": TableSchema(
        "enemdu_vivienda",
        keys=["id_vivienda", "id_hogar"],
        required=["vi01", "vi02"],
        optional=["vi05a", "vi03a"],
        partition=["ciudad"],
        geographic=["ciudad"],
        categorical=["vi01", "vi02"],
    ),
}

# --- Fixed values: wide tables -----------------------------------------------------

CENSUS_PERSON_COLUMNS = {
    "ID_VIV": "idVivienda",
    "ID_HOG": "idHogar",
    "ID_PER": "idPersona",
    "P03": "edad",
    "P02": "sexoCodigo",
    "I01": "provinciaCodigo",
    "I02": "ubicacionCodigo",
    "CANTON": "cantonCodigo",
}
CENSUS_PERSON_FEATURES = [
    "sexo_descripcion",
    "grupo_edad",
    "es_",
    "tiene_",
    "nivel_",
    "indice_",
    "categoria_",
    "target_",
    "provinciaNombre",
    "cantonNombre",
]
HOUSEHOLD_FEATURES = ["tamaño_hogar", "edad_", "ratio_", "dependientes_"]
CENSUS_HOUSEHOLD_COLUMNS = {"H01": "numeroDormitorios", "H1303": "totalPersonasHogar"}
CENSUS_DWELLING_COLUMNS = {"V01": "tipoViviendaCodigo", "V0201R": "materialParedesCodigo"}
CENSUS_DWELLING_FEATURES = ["tipo", "material", "condicion", "agua", "energia", "servicio"]
SURVEY_PERSON_COLUMNS = {
    "id_vivienda": "idVivienda",
    "id_hogar": "idHogar",
    "id_persona": "idPersona",
    "p24": "horasTrabajadasSemana",
    "ingrl": "ingresoLaboral",
    "p03": "edad",
}
SURVEY_PERSON_FEATURES = [
    "sexo_",
    "grupo_",
    "es_",
    "tiene_",
    "categoria_",
    "target_",
    "provinciaNombre",
    "cantonNombre",
    "region_",
]
SURVEY_DWELLING_COLUMNS = {"vi01": "tipoViviendaEnemdu", "vi02": "materialParedesEnemdu"}
SURVEY_DWELLING_FEATURES = ["tipo", "material", "agua", "servicio"]

# keys and province columns of the wide tables, by their new names
WIDE_TABLE_KEYS = ["idVivienda", "idHogar", "idPersona"]
WIDE_TABLE_PROVINCE = ["provinciaCodigo", "provinciaNombre"]

# wide table -> candidate partition columns, and clustering columns
PARTITION_CANDIDATES = {
    "censo_master": ["I01", "provinciaCodigo", "codigo_provincia_2d"],
    "enemdu_master": ["ciudad", "codigo_provincia_2d"],
}
CLUSTER_COLUMNS = {
    "censo_master": ["provinciaCodigo", "edad"],
    "enemdu_master": ["ciudad", "edad"],
}

# --- Fixed values: model features ----------------------------------------------------

BENCHMARK_FEATURES = [
    ["poblacion_total", "densidad_relativa", "ranking_", "percentil_"],
    ["es_poblacion_activa", "es_dependiente", "es_mujer", "es_urbano"],
]
BENCHMARK_FEATURE_LIMIT = 15
BASELINE_FEATURES = ["edad", "sexo", "P02", "P03"]
AUTOMATED_FEATURES = ["grupo_edad", "es_", "tiene_", "nivel_", "indice_", "categoria_"]
ENSEMBLE_FEATURES = [
    (["grupo_edad", "sexo_", "es_poblacion"], 5),
    (["poblacion_total", "densidad_", "es_urbano"], 3),
    (["indice_", "categoria_", "nivel_"], 4),
]
EXCLUDED_FEATURES = ["target_", "id_", "ID_", "codigo_", "_codigo", "timestamp"]
CODE_SUFFIX = "Codigo"
# what an index takes in beside the sources its catalog entry names
FURTHER_SOURCES = {"indice_vulnerabilidad_compuesto": ["ocupacion"]}
# source -> terms in the names of the columns that hold it
SOURCE_TERMS = {
    "educacion": EDUCATION_COLUMN_TERMS,
    "ocupacion": EMPLOYMENT_COLUMN_TERMS,
    "parentesco": KINSHIP_COLUMN_TERMS,
    "ingreso": INCOME_COLUMN_TERMS,
}
PRIORITY_FEATURES = ["grupo_", "es_", "tiene_", "indice_", "categoria_", "nivel_"]
PRIORITY_FEATURE_LIMIT = 10
SECONDARY_FEATURE_LIMIT = 5

# columns of the wide tables that hold numbers as text
NUMERIC_TEXT = [
    "edad",
    "horasTrabajadasSemana",
    "ingresoLaboral",
    "numeroDormitorios",
    "totalPersonasHogar",
]

MODEL_TYPES = ["RandomForest", "GradientBoosting", "LogisticRegression"]
MIN_CLASS_ROWS = 100
MIN_TRAINING_ROWS = 1000
TRAIN_SHARE = 0.8
SEED = 42
