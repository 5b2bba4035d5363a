import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def census(spark):
    """The small census fixture: two dwellings of one household and two persons each."""
    return {
        "poblacion": spark.createDataFrame(
            [
                (1, 1, 1, "01", "a", "0101", "1", "25", "Superior", "Jefe de hogar", "1"),
                (1, 1, 2, "01", "a", "0101", "2", "30", "Primaria", "Conyuge", "1"),
                (2, 1, 1, "2", "b", "201", "1", "45", None, "Representante", "2"),
                (2, 1, 2, "2", "b", "201", "2", "70", "Bachillerato", "Hijo", "2"),
            ],
            "ID_VIV long, ID_HOG long, ID_PER long, I01 string, I02 string, CANTON string, P02 string, P03 string, "
            "nivel_instruccion string, parentesco string, AUR string",
        ),
        "hogar": spark.createDataFrame(
            [(1, 1, "01", 3, 4), (2, 1, "02", 2, 3)], "ID_VIV long, ID_HOG long, I01 string, H01 int, H1303 int"
        ),
        "vivienda": spark.createDataFrame(
            [(1, "1", "3", "losa"), (2, "2", "4", "zinc")],
            "ID_VIV long, V01 string, V0201R string, material_techo string",
        ),
        "dict_provincia": spark.createDataFrame([(1, "Azuay"), (2, "Bolivar")], "CODIGO int, NOMBRE string"),
        "dict_canton": spark.createDataFrame([(101, "Cuenca"), (201, "Guaranda")], "CODIGO int, NOMBRE string"),
        "dict_parroquia": spark.createDataFrame(
            [(10101, "Banos"), (20150, "Salinas"), (30101, "Sin canton")], "CODIGO int, NOMBRE string"
        ),
        "dict_censo": spark.createDataFrame(
            [
                ("P02", "1", "Hombre", "sexo", "SI"),
                ("P02", "2", "Mujer", "sexo", "si"),
                ("AUR", "1", "Urbano", None, "SI"),
                ("AUR", "2", None, None, "SI"),
                ("I02", "a", "A", "ubicacion", "NO"),
            ],
            "variable_codigo string, codigo string, etiqueta string, campo string, requiere_recodificacion string",
        ),
    }
