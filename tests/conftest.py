import pytest

from eventloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "6g", {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
