import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import passages  # noqa: E402

cloudpickle.register_pickle_by_value(passages)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "checkpoints"))
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden():
    """A text, its four passages at 25 tokens with an overlap of 5, and
    the vectors of the deterministic model below."""
    text = "I often make this joke which is agile's a lot like communism you know people just keep not trying it correctly um what is what is the correct way to Agile oh gee um it's a real simple idea right uh do things in really short sequences measure how much you get done in every sequence use that measurement to project an end date and tell everybody that's kind of it"  # noqa: E501
    parts = [
        "I often make this joke which is agile's a lot like communism you know people just keep not trying it correctly um",  # noqa: E501
        "not trying it correctly um what is what is the correct way to Agile oh gee um it's a real simple idea",  # noqa: E501
        "a real simple idea right uh do things in really short sequences measure how much you get done in every sequence use that",  # noqa: E501
        "in every sequence use that measurement to project an end date and tell everybody that's kind of it",  # noqa: E501
    ]
    vectors = [
        [-0.34710384916349935, -1.1611512293332775],
        [-1.708373551760354, 0.33429172440673527],
        [0.07570851080112607, -0.3293924052367194],
        [0.5019245986862018, -0.2722309603366409],
    ]
    return text, parts, vectors


@pytest.fixture(scope="session")
def make_fake_model():
    """A model whose vector of a text is drawn with the text's hash as the seed."""

    def make():
        import hashlib

        import numpy as np

        def embed(texts):
            vectors = []
            for text in texts:
                seed = int(hashlib.sha256(text.encode()).hexdigest(), 16) % 10**8
                vectors.append(np.random.RandomState(seed).normal(size=2).tolist())
            return vectors

        return embed

    return make
