import io
import json
import zipfile

import pytest

from hanloom.__main__ import main
from hanloom.sources.lexicon import read_pack


def test_convert_and_segment(spark, tmp_path, capsysbinary):
    (tmp_path / "a.txt").write_bytes("喫“茶”".encode("big5"))
    assert main(["convert", "-i", str(tmp_path / "a.txt"), "-o", str(tmp_path / "b.txt"), "-c", "t2tw", "-p", "--in-enc", "big5"]) == 0
    assert (tmp_path / "b.txt").read_text(encoding="utf-8") == "吃「茶」"
    (tmp_path / "w.txt").write_text("茶葉 100 n\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("好茶葉", encoding="utf-8")
    assert main(["segment", "-i", str(tmp_path / "c.txt"), "-U", str(tmp_path / "w.txt"), "-m", "tag", "-d", " "]) == 0
    assert "好/x 茶葉/n" in capsysbinary.readouterr().out.decode()
    model = {"start": {"B": -0.1, "S": -3}, "move": {"B": {"E": -0.1, "M": -3}, "M": {"M": -1, "E": -1}, "E": {"B": -0.5, "S": -0.5}, "S": {"B": -0.5, "S": -0.5}}, "emit": {"B": {"甲": -1}, "E": {"乙": -1}, "S": {"丙": -1}, "M": {}}}
    (tmp_path / "hmm.json").write_text(json.dumps(model), encoding="utf-8")
    (tmp_path / "u.txt").write_text("甲乙丙", encoding="utf-8")
    for flag, want in (("--hmm", "甲乙/丙"), ("--no-hmm", "甲/乙/丙")):
        assert main(["segment", "-i", str(tmp_path / "u.txt"), "--hmm-model", str(tmp_path / "hmm.json"), flag]) == 0
        assert want in capsysbinary.readouterr().out.decode()
    assert main(["segment", "-i", str(tmp_path / "u.txt"), "--hmm-model", str(tmp_path / "u.txt")]) == 2
    assert main(["convert", "-i", str(tmp_path / "none.txt"), "-c", "t2tw"]) == 2
    assert main(["convert", "-i", str(tmp_path / "a.txt"), "-c", "t2mars"]) == 2


def test_office_and_lexicon(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:t>喫</w:t>")
    (tmp_path / "喫.docx").write_bytes(out.getvalue())
    assert main(["office", "-i", str(tmp_path / "喫.docx"), "-c", "t2tw", "--convert-filename"]) == 0
    assert zipfile.ZipFile(tmp_path / "吃_converted.docx").read("word/document.xml").decode() == "<w:t>吃</w:t>"
    (tmp_path / "d.txt").write_text("甲\t乙", encoding="utf-8")
    assert main(["build-lexicon", "-o", str(tmp_path / "p.zst"), "-D", f"STPhrases:append:{tmp_path / 'd.txt'}"]) == 0
    assert read_pack(str(tmp_path / "p.zst")).table("STPhrases") == {"甲": "乙"}
    with pytest.raises(SystemExit):
        main([])
