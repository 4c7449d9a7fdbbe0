import __spark_entry__


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() > 0


def test_without_llm(monkeypatch):
    """The other queries are there when the subpackage and the pipeline are not."""
    import sys

    for name in [n for n in sys.modules if n.startswith("skein.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, *_):
            if name.startswith("skein.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    import skein

    monkeypatch.delattr(skein, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    names = set(__spark_entry__.queries())
    assert "callers" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
