import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from comarca.session import local_session  # noqa: E402

MASTER = [
    ("AGS", "01", "Aguascalientes", ["Aguascalientes"], "Bajio", "Aguascalientes"),
    ("BCN", "02", "Baja California", ["Baja California"], "Noroeste", "Mexicali"),
    ("BCS", "03", "Baja California Sur", [], "Noroeste", "La Paz"),
    ("MEX", "15", "Mexico", ["Estado de Mexico", "México"], "Centro", "Toluca de Lerdo"),
    ("NLE", "19", "Nuevo Leon", ["Nuevo León", "N.L."], "Noreste", "Monterrey"),
    ("QUE", "22", "Queretaro", ["Querétaro"], "Bajio", "Santiago de Queretaro"),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def master(spark):
    return spark.createDataFrame(
        MASTER, "state_code string, cve_ent string, estado string, aliases array<string>, region string, capital string"
    )


@pytest.fixture(scope="session")
def wide(spark):
    """Three entities; the third lacks every metric."""

    def build(values: dict[str, list], with_map: bool = True):
        names = list(values)
        rows = []
        for i, (code, name) in enumerate([("01", "Uno"), ("02", "Dos"), ("03", "Tres")][: len(next(iter(values.values())))]):
            rows.append((code, name, {n: float(values[n][i]) for n in names if values[n][i] is not None}))
        df = spark.createDataFrame(rows, "cve_ent string, estado string, metrics map<string,double>")
        if with_map:
            return df
        from comarca.operators.observations import unpack_metrics

        return unpack_metrics(df, names)

    return build
