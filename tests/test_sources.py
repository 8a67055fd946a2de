import io
import zipfile

import pytest

from hanloom.errors import DocumentError, EntryError, LexiconReadError, LexiconVersionError, SlotError, UserWordError
from hanloom.plans.configs import slot
from hanloom.sources import files, office
from hanloom.sources import lexicon as lx


def test_tables():
    text = "﻿# comment\n\n甲\t乙 丙\nbad\n丁\t\n"
    table, bad = lx.parse_table(text, "f", bom="line")
    assert table == {"甲": "乙"} and [b.split(":")[1] for b in bad] == ["4", "5"]
    with pytest.raises(EntryError, match=":4:"):
        lx.parse_table(text, "f", strict=True, bom="line")
    assert lx.parse_table("# c\n﻿甲\t乙")[0] == {"甲": "乙"}


def test_overlays():
    base = lx.builtin()
    new = base.with_tables([lx.CustomTable("stphrases", (("a", "b"),)), lx.CustomTable("STPhrases", (("a", "c"),))])
    assert new.table("STPhrases") == {"a": "c"} and not base.table("STPhrases")
    assert new.with_tables([lx.CustomTable("STPhrases", (("x", "y"),), "Override")]).table("STPhrases") == {"x": "y"}
    with pytest.raises(EntryError):
        new.with_tables([lx.CustomTable("STPhrases", (("k", "v"),)), lx.CustomTable("STPhrases", (("", "v"),))])
    assert new.table("STPhrases") == {"a": "c"}


def test_slots():
    assert slot("  stphrases ") == "STPhrases" and slot("JPShinjitaiPhrases") == "JPSPhrases"
    for bad in ("STPhrases.txt", ""):
        with pytest.raises(SlotError):
            slot(bad)
    with pytest.raises(SlotError):
        slot("stphrases", exact=True)


def test_overlay_frames(spark):
    base = spark.createDataFrame([("S", "a", "1"), ("S", "b", "2"), ("T", "a", "3")], "slot string, key string, value string")
    changes = spark.createDataFrame([(0, "S", "append", "c", "4"), (1, "S", "override", "d", "5"), (2, "S", "append", "d", "6"), (3, "T", "append", "a", "7")], lx.OVERLAY)
    assert {(r.slot, r.key, r.value) for r in lx.overlay(base, changes).collect()} == {("S", "d", "6"), ("T", "a", "7")}
    assert lx.overlay(base, changes.limit(0)).count() == 3


def test_stats(spark):
    long = "長" * 70
    rows = lx.Lexicon({"STPhrases": {"a": "b", "cd": "e", long: "x"}}).frame(spark)
    r = lx.key_stats(rows).first()
    assert (r.min_len, r.max_len, r.len_mask, r.long_lengths) == (1, 70, 3, [70])


def test_packs(tmp_path):
    lexicon = lx.builtin()
    for pretty, compressed in ((True, False), (False, True)):
        lx.write_pack(lexicon, str(tmp_path / "p"), pretty, compressed)
        assert {k: v for k, v in lx.read_pack(str(tmp_path / "p")).tables.items() if v} == lexicon.tables
    with pytest.raises(LexiconVersionError):
        lx.from_pack(b'{"schema_version": 4}')
    for bad in (b"{", b"{}", b'{"schema_version": 3, "other": {"map": {}}}', b"\x28\xb5\x2f\xfdxx"):
        with pytest.raises(LexiconReadError):
            lx.from_pack(bad)
    old = lx.from_pack(b'{"schema_version": 2, "jp_variants": {"map": {"\xe8\x88\x8a": "\xe6\x97\xa7"}}}')
    assert old.legacy["jp_variants"] == {"舊": "旧"}


def test_old_packs(spark):
    from hanloom.operators.engine import Engine

    old = lx.from_pack('{"schema_version": 2, "jp_variants": {"map": {"舊": "旧"}}, "jp_variants_rev": {"map": {"旧": "舊"}}}'.encode())
    e = Engine(spark, old)
    rows = spark.createDataFrame([("舊旧",)], "t string").select(e.convert("t", "t2jp").alias("a"), e.convert("t", "jp2t").alias("b")).first()
    assert rows == ("旧旧", "舊舊")


def test_words(spark, tmp_path):
    assert lx.parse_words("云计算 100 n\n\nx +3\n") == [lx.UserWord("云计算", 100, "n"), lx.UserWord("x", 3)]
    for bad in ("x", "x y", "a 1 n z", "a -1"):
        with pytest.raises(UserWordError, match=":1:"):
            lx.parse_words(bad)
    lines = spark.createDataFrame(list(enumerate(["a 1 n", " ", "b", "c +2", "d x", None])), "line_no int, line string")
    assert {r.line_no: (r.word, r.freq, r.tag, r.ok) for r in lx.validate_words(lines).collect()} == {0: ("a", 1, "n", True), 2: (None, None, None, False), 3: ("c", 2, None, True), 4: (None, None, None, False)}
    (tmp_path / "t.txt").write_text("# c\n甲\t乙 丙\nbad\n甲\t丁\n", encoding="utf-8")
    assert [(r.key, r.value) for r in lx.scan_table(spark, str(tmp_path / "t.txt"), "STPhrases").collect()] == [("甲", "丁")]
    assert lx.parse_spec(f"stphrases:Append:{tmp_path / 't.txt'}".replace("t.txt", "u.txt")) if (tmp_path / "u.txt").write_text("a\tb") else None
    with pytest.raises(EntryError):
        lx.parse_spec("STPhrases:append")


def test_charsets(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("漢字".encode("gbk"))
    assert files.read_texts(spark, str(tmp_path / "a.txt"), "GBK").first()["text"] == "漢字"
    (tmp_path / "b.txt").write_bytes(b"a\xff\n")
    assert files.read_texts(spark, str(tmp_path / "b.txt")).first()["text"] == "a�\n"
    df = spark.createDataFrame([("﻿漢",)], "t string")
    assert bytes(df.select(files.encode(df.t, "big5").alias("x")).first()["x"]) == "漢".encode("big5")
    with pytest.raises(DocumentError):
        files.check_charset("nope-8")
    with pytest.raises(DocumentError):
        files.check_paths(str(tmp_path / "a.txt"), str(tmp_path / "a.txt"))


def container(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def test_office(spark, tmp_path):
    up = str.upper
    data = container(word__document_xml='<w:t w:ascii="font">abc</w:t>', other_xml="abc")
    new, n = office.convert_bytes(data, "docx", lambda t: t.replace("abc", "xyz").replace("font", "FONT"))
    z = zipfile.ZipFile(io.BytesIO(new))
    assert n == 1 and z.read("word/document.xml") == b'<w:t w:ascii="font">xyz</w:t>' and z.read("other.xml") == b"abc"
    sheet = '<c r="A1" t="inlineStr"><is><t>abc</t></is></c><c r="B1"><f>abc</f></c>'
    new, _ = office.convert_bytes(container(xl__worksheets__s_xml=sheet), "xlsx", up)
    assert zipfile.ZipFile(io.BytesIO(new)).read("xl/worksheets/s.xml").decode() == sheet.replace("<t>abc", "<t>ABC")
    for bad, kind in ((b"", "docx"), (b"x", "docx"), (container(a="b"), "docx"), (container(a="b"), "doc"), (container(a_xml="b"), "epub")):
        with pytest.raises(DocumentError):
            office.convert_bytes(bad, kind, up)
    book = container(**{"c.xhtml": "abc", "mimetype": "application/epub+zip"})
    new, _ = office.convert_bytes(book, "epub", up)
    first = zipfile.ZipFile(io.BytesIO(new)).infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    assert not office.is_safe("../x") and not office.is_safe("/x") and office.is_safe("a/b")
    (tmp_path / "d.docx").write_bytes(data)
    (tmp_path / "e.docx").write_bytes(b"no")
    found = {r.path.rsplit("/", 1)[-1]: r for r in office.convert_files(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"), lambda: up).collect()}
    assert found["d.docx"].success and not found["e.docx"].success and found["e.docx"].content is None
    office.replace_file(str(tmp_path / "d.docx"), new)
    assert (tmp_path / "d.docx").read_bytes() == new and sorted(p.name for p in tmp_path.iterdir()) == ["d.docx", "e.docx"]
