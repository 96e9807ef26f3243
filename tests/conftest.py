import pytest

from quern import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    built = session.build(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "3g",
            "spark.checkpoint.dir": f"file://{folder}",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
