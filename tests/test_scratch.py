"""Where intermediate tables go, and what is left of the entry without the text operators."""

import importlib

import pytest

from clicktrail.sources import scratch


class Session:
    """As much of a session as the folder depends on."""

    def __init__(self, master, named=None):
        self.conf = self
        self.sparkContext = self
        self.master, self._named = master, named

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self._named, "spark.sql.warehouse.dir": "file:/warehouse"}[key]

    def getCheckpointDir(self):
        return None


def test_the_shared_folder_is_needed_on_a_cluster():
    assert scratch.scratch_folder(Session("local[2]")) == "file:/warehouse-scratch"
    for master in ("yarn", "spark://host:7077", "k8s://host"):
        assert scratch.scratch_folder(Session(master, "hdfs:/shared/")) == "hdfs:/shared"
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_folder(Session(master))


def test_the_entry_does_without_what_cannot_be_imported(monkeypatch, capsys):
    import __spark_entry__

    found = importlib.import_module

    def without(name, *rest):
        if name == "clicktrail.llm.queries":
            raise ImportError("No module named 'some_tokenizer'")
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'corpus_pipeline'")
        return found(name, *rest)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", without)
    names = __spark_entry__.queries()
    assert "top_queries" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert "some_tokenizer" in capsys.readouterr().err
