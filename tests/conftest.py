import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def graph(spark):
    """Three nodes and one edge: what depends on auth?"""
    from quillgraph.sources.store import ENTITY, RELATION

    def node(id, kind, title, summary, content, tags, props=None):
        return (id, kind, title, summary, content, None, None, tags, props, "2026-03-21T14:00:00Z", "2026-03-21T14:00:00Z", "developer", "developer", "sess-42", "sess-42")

    nodes = [
        node("component:authentication", "Subsystem", "Authentication subsystem", "Handles user authentication, tokens, and session checks for the platform", "Authentication verifies identity before protected requests are accepted.", ["security", "identity"], '{"aliases":["identity-service"]}'),
        node("service:login-api", "Service", "Login API", "Accepts login requests and depends on the authentication subsystem", None, ["api"]),
        node("service:billing", "Service", "Billing service", "Handles invoices and payment reconciliation", None, ["payments"]),
    ]
    edges = [("service:login-api", "DEPENDS_ON", "component:authentication", None, "2026-03-21T14:00:00Z", "2026-03-21T14:00:00Z", "developer", "developer", "sess-42", "sess-42")]
    return spark.createDataFrame(nodes, ENTITY), spark.createDataFrame(edges, RELATION)
