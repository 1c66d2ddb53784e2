import builtins
import warnings

import pytest

import __spark_entry__
from loomspark.functions import staging
from loomspark.plans.queries import QUERIES


def test_queries_without_the_optional_subpackage(monkeypatch):
    """Whatever of it cannot be imported, the other queries stay."""
    real = builtins.__import__
    for missing in ("corpus_pipeline", "loomspark.llm"):

        def fails(name, *rest, missing=missing):
            if name == missing or (missing == "loomspark.llm" and name == "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named 'x' in {missing}")
            return real(name, *rest)

        monkeypatch.setattr(builtins, "__import__", fails)
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            assert set(__spark_entry__.queries()) == set(QUERIES)
        assert said and "left out" in str(said[0].message)


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Session)
