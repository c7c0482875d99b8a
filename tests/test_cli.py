from quire.cli import main

from .test_checks import page


def client(texts, start, end, context):
    if texts[0] == "bad":
        raise ValueError("bad page")
    return {"md": "\n".join(page(k, t) for k, t in enumerate(texts, start)), "input_tokens": 1, "output_tokens": 1, "cache_creation_tokens": 0, "cache_read_tokens": 0}


def test_validate(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text(page(1, "x"))
    assert main(["validate", str(tmp_path)], spark) == 0
    (tmp_path / "b.MD").write_text("no marks")
    assert main(["validate", str(tmp_path)], spark) == 1
    assert "Page markers, b: 1 errors, 0 warnings" in capsys.readouterr().out


def test_rules(spark, tmp_path, capsys):
    path = str(tmp_path / "r.txt")
    assert main(["init-rules", path]) == 0 and "; @replace tables" in open(path).read()
    (tmp_path / "own.txt").write_text("@add\nMy rule")
    assert main(["show-prompt", "--rules", str(tmp_path / "own.txt")], spark) == 0
    assert "9. My rule" in capsys.readouterr().out


def test_convert_and_merge(spark, tmp_path, capsys):
    root, pages = str(tmp_path / "w"), str(tmp_path / "p")
    spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (1, 3, "three"), (2, 1, "bad")], "doc_id bigint, page_no int, pdf_text string").write.parquet(pages)
    assert main(["convert", root, "--pages", pages, "--client", "tests.test_cli:client", "--pages-per-chunk", "2"], spark) == 1
    assert "1 documents written, 1 failed" in capsys.readouterr().out
    assert spark.read.parquet(f"{root}/output").first().md == "\n\n".join(page(k, t) for k, t in ((1, "one"), (2, "two"), (3, "three"))) + "\n"
    assert main(["convert", root, "--from", "merge"], spark) == 0
    assert main(["convert", root, "--from", "merge", "--force"], spark) == 2
    assert main(["convert", root], spark) == 2
