"""Folders of derived contribution files."""

from hexvigil.plans import sources


def test_text_folders_are_compressed(spark, tmp_path, monkeypatch):
    """JSON lines repeat their keys; a folder of them takes a fraction of its text and reads back whole."""
    monkeypatch.setattr(sources, "scratch_path", lambda _, name: str(tmp_path / name))
    kinds = sources.mixed_shapes(spark, "/root/testdata/sf0.001").collect()
    files = list(tmp_path.glob("mixed/part-*"))
    text = spark.read.text([str(f) for f in files])
    written, whole = sum(f.stat().st_size for f in files), text.selectExpr("sum(length(value) + 1)").first()[0]
    assert files and written * 4 < whole
    assert len(kinds) == 7
