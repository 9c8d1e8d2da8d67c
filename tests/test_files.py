"""Released files and reference rows: what is written is what is read."""

import glob
from collections import Counter

from tallyroom.sources import readers, writers


def test_cells_and_their_order_survive_files(spark, tmp_path):
    odd = ["plain", None, "", " blanks ", 'a "quoted" cell', "two\nlines", "comma, and 'apostrophe'", "Ünïcode", '"', "\\"]
    rows = [(i, odd[i % len(odd)], i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, cell string, place long")
    for quote_all in (False, True):
        path = str(tmp_path / f"csv{quote_all}")
        writers.write_csv(df.repartition(5), path, ["place"], quote_all, rows_per_file=90)
        files = sorted(glob.glob(f"{path}/part-*"))
        assert len(files) >= 12 and open(files[0], newline="", encoding="utf-8").readline() == ('"id","cell","place"\r\n' if quote_all else "id,cell,place\r\n")
        read = [r for f in files for r in writers.read_csv(spark, f, ["id", "cell", "place"]).collect()]
        assert [int(r["place"]) for r in read] == sorted(x[2] for x in rows)
        keep = (lambda c: c or None) if quote_all else (lambda c: c)  # a quoted null is an empty text
        assert Counter((int(r["id"]), keep(r["cell"])) for r in read) == Counter((i, keep(c)) for i, c, _ in rows)


def test_reference_rows_carry_their_problems(spark, tmp_path):
    lines = ['{"student": 1, "field": "name", "text": "Asha"}', '{"student": "2", "field": "name", "text": null}', '{"student": "3", "field": "name", "text": 5}', "{broken", '{"student": "4", "field": "name"}', ""]
    (tmp_path / "rows.json").write_text("\n".join(lines))
    got = {tuple(r) for r in readers.read_reference_rows(spark, str(tmp_path / "rows.json")).collect()}
    assert got == {("1", "name", "Asha", None), ("2", "name", None, None), ("3", "name", None, "text must be a string"), (None, None, None, "no JSON"), ("4", "name", None, None)}


def test_manifest_hashes_the_bytes_of_files(spark, tmp_path):
    import hashlib

    for name, data in (("a.pdf", b"one"), ("b.pdf", b""), ("c.txt", b"three"), ("d.pdf", b"four" * 9000)):
        (tmp_path / name).write_bytes(data)
    got = {(r["key"].rsplit("/", 1)[1], r["size"], r["digest"]) for r in readers.file_manifest(spark, str(tmp_path), "*.pdf").collect()}
    assert got == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a.pdf", b"one"), ("d.pdf", b"four" * 9000))}
