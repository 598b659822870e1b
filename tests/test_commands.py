import json

from pyspark.sql import functions as F

from foliograph.__main__ import main
from foliograph.operators import styles
from foliograph.plans import commands
from foliograph.sources import packages
from tests.test_sources import compound_file, padded


def test_commands_over_folders(spark, tmp_path, capsys):
    md, made = tmp_path / "md", tmp_path / "made"
    for d in (md, made):
        d.mkdir()
    (md / "a.md").write_text("---\ntitle: x\n---\n# Head\n\ntext *here*\n\n| h |\n|---|\n| c1 |\n\n<!-- x:section -->\n\nsecond\n")
    rows = commands.convert(spark, str(md)).collect()
    (made / "a.zip").write_bytes(bytes(rows[0].content))
    found = {r.section: (r.paragraphs, r.deep_paragraphs, r.tables) for r in commands.inspect(spark, str(made)).collect()}
    assert packages.parse(bytes(commands.convert(spark, str(md), "classic").head().content))["fonts"][0]["face"] == "바탕"
    assert found == {0: (3, 4, 1), 1: (1, 1, 0)}
    text = commands.to_md(spark, str(made)).head().markdown
    assert "text here" in text and "| c1 |" in text and text.endswith("second")
    assert [(r.valid, r.error) for r in commands.check(spark, str(made)).collect()] == [(True, None)]
    exported = commands.to_json(spark, str(made)).head().json
    js = tmp_path / "js"
    js.mkdir()
    (js / "a.json").write_text(exported)
    again = packages.parse(bytes(commands.from_json(spark, str(js)).head().content))
    assert [r["text"] for r in again["runs"]] == ["Head", "text here", "second"]
    restyled = commands.restyle(spark, str(made), "modern").collect()
    assert [(packages.parse(bytes(r.content))["fonts"][0]["face"], r.error) for r in restyled] == [("맑은 고딕", None)]
    old = packages.parse((made / "a.zip").read_bytes())
    assert [r["text"] for r in packages.parse(bytes(restyled[0].content))["runs"]] == [r["text"] for r in old["runs"]]
    slot = packages.parse((made / "a.zip").read_bytes())
    assert slot["warnings"] == []
    from foliograph.sources.patching import export

    out = export((made / "a.zip").read_bytes(), 0)
    path = spark.read.format("binaryFile").load(str(made)).head().path
    (tmp_path / "changes.json").write_text(json.dumps({"doc_id": path, "section": 0, "sha256": out["sha256"], "path": out["slots"][0]["path"], "text": "New"}))
    patched = commands.patch(spark, str(made), str(tmp_path / "changes.json")).head()
    assert patched.error is None and packages.parse(bytes(patched.content))["runs"][0]["text"] == "New"
    main(["schema", "runs"])
    assert '"char_shape"' in capsys.readouterr().out
    main(["validate", str(made), "--out", str(tmp_path / "valid")])
    assert spark.read.parquet(str(tmp_path / "valid")).count() == 1


def test_legacy_conversion_audits_clean(spark, tmp_path):
    from foliograph.sources import compound
    import struct

    text = lambda s: compound.make_record(66, 0, b"") + compound.make_record(67, 1, s.encode("utf-16-le"))
    data = compound_file({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05010100, 0), "BodyText/Section0": padded(text("one") + text("두 번째"))})
    source, output = tmp_path / "in", tmp_path / "out"
    for d in (source, output):
        d.mkdir()
    (source / "d.bin").write_bytes(data)
    (output / "d.zip").write_bytes(bytes(commands.convert_legacy(spark, str(source)).head().content))
    row = commands.audit(spark, str(source), str(output)).head()
    assert row.status == "MATCH" and row.paragraphs_source == 2
    assert commands.summary(commands.audit(spark, str(source), str(output))).collect()[0].documents == 1
    assert commands.census(spark, str(source)).filter("name = 'ParaText'").head().n == 2


def test_style_sets(spark):
    assert [len(styles.style_set(v)) for v in ("classic", "modern", "latest")] == [18, 22, 23]
    names = spark.createDataFrame([("개요 1",), ("Outline 8",), ("바탕글",), ("unknown",)], "n string")
    assert [r.i for r in names.select(styles.style_id(F.col("n")).alias("i")).collect()] == [2, 9, 0, None]
