import os

import pytest
from pyspark.sql import functions as F

from cutline.functions import text
from cutline.operators import cleaning
from cutline.schemas import RAW_ROUND_SCHEMA
from cutline.sources import file_audit, round_files, side_tables, tables


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


@pytest.mark.parametrize("raw,rank,flag", [
    ("123P", 123, True), ("123p", 123, True), ("5057.0", 5057, False), ("1,234", 1234, False), ("", None, False),
    ("--", None, False), ("0.01", 0, False), (" 77 ", 77, False), ("12d", None, False), ("-2.7", -2, False), ("1e3", 1000, False),
])
def test_rank_text(spark, raw, rank, flag):
    t = text.rank_text(F.col("v"))
    got = one(spark, raw, text.cut_to_whole(text.rank_number(t)), text.rank_has_suffix(t))
    assert tuple(got) == (rank, flag)


@pytest.mark.parametrize("seat,category,pwd", [
    ("OBC-NCL (PwD)", "OBC-NCL", True), ("OPEN", "OPEN", False), ("EWS", "EWS", False), ("GEN-EWS", "OPEN", False),
    ("SC PwD", "SC", True), (None, "OPEN", False), ("XYZ", "OPEN", False),
])
def test_seat_type(spark, seat, category, pwd):
    got = one(spark, seat, text.seat_category(text.seat_base(F.col("v"))), text.seat_is_pwd(F.col("v")))
    assert tuple(got) == (category, pwd)


def test_institute_type_order(spark):
    kinds = {
        "Indian Institute of Technology Bombay": "IIT", "National Institute of Technology, Goa": "NIT",
        "Indian Institute of Information Technology Pune": "IIIT", "IIIT Delhi": "IIIT", "Assam University": "GFTI"}
    rows = spark.createDataFrame([(k,) for k in kinds], "v string").select("v", text.institute_type(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == kinds


def test_program_parts(spark):
    p = text.program_parts(F.col("v"))
    got = one(spark, "Civil Engineering (4 Years, Bachelor of Technology)", *p.values())
    assert tuple(got) == ("Civil Engineering", "Civil Engineering", 4, "Bachelor of Technology")
    assert tuple(one(spark, "Plain", *p.values())) == ("Plain", "Plain", None, None)
    assert tuple(one(spark, None, *p.values())) == ("", None, None, None)


def test_clean_rounds_keeps_first_copy(spark):
    columns = [*[f.name for f in RAW_ROUND_SCHEMA.fields], "year", "round", "source_file", "source_row_id"]
    base = ("NIT X ", "Civil (4 Years, BTech)", "AI", "OPEN", "Gender-Neutral")
    rows = [
        (*base, "20", "30", 2020, 1, "a.csv", 1), (*base, "10", "15", 2020, 1, "a.csv", 0), (*base, "--", "", 2020, 1, "a.csv", 2),
        (*base, "0.01", "9", 2020, 2, "a.csv", 3), (*base, None, "9", 2020, 3, "a.csv", 4)]
    raw = spark.createDataFrame(rows, columns)
    got = {r["round"]: (r["opening_rank"], r["closing_rank"], r["source_row_id"]) for r in cleaning.clean_rounds(raw).collect()}
    assert got == {1: (10, 15, 0), 3: (None, 9, 4)}


def write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_round_files(spark, tmp_path):
    modern = "Institute,Academic Program Name,Quota,Seat Type,Gender,Opening Rank,Closing Rank"
    legacy = "Institute,Academic Program Name,Quota,Seat Type,Opening Rank,Closing Rank"
    write(tmp_path, "2018_round_2.csv", [modern, 'A ,"P (4 Years, B)",AI,OPEN,Female-only,1,2', "B,Q,n/a,OPEN,Gender-Neutral,3,--"])
    write(tmp_path, "2016_round_1.csv", [legacy, "C,R,HS,SC,5,6"])
    write(tmp_path, "2016_round_1.csv:Zone.Identifier", ["x"])
    write(tmp_path, "notes.csv", ["x"])
    rows = {(r["source_file"], r["source_row_id"]): r for r in round_files.load_rounds(spark, str(tmp_path)).collect()}
    assert set(rows) == {("2018_round_2.csv", 0), ("2018_round_2.csv", 1), ("2016_round_1.csv", 0)}
    assert rows["2018_round_2.csv", 0]["Academic Program Name"] == "P (4 Years, B)"
    assert rows["2018_round_2.csv", 0]["Institute"] == "A"
    assert rows["2018_round_2.csv", 1]["Quota"] is None and rows["2018_round_2.csv", 1]["Closing Rank"] is None
    assert rows["2016_round_1.csv", 0]["Gender"] == "Gender-Neutral" and rows["2016_round_1.csv", 0]["year"] == 2016


def test_row_numbers_across_splits(spark, tmp_path):
    header = "Institute,Academic Program Name,Quota,Seat Type,Gender,Opening Rank,Closing Rank"
    write(tmp_path, "2019_round_1.csv", [header] + [f"I{i},P,AI,OPEN,Gender-Neutral,{i},{i}" for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = round_files.load_rounds(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = {int(r["Opening Rank"]): r["source_row_id"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: i for i in range(2000)}


def test_seat_matrix_file(spark, tmp_path):
    path = write(tmp_path, "seats.csv", [
        '"Institute Name",Program Name,Seat Pool,OPEN,OPEN-PwD,SC,Total', "X,Civil,Gender-Neutral,\"1,200\",3,,9",
        ",,Female-only,7,,n/a,1"])
    got = {(r["institute"], r["program"], r["seat_pool"], r["category"]): r["seat_count"]
           for r in side_tables.read_seat_matrix(spark, path).collect()}
    assert got == {("X", "Civil", "Gender-Neutral", "OPEN"): 1200, ("X", "Civil", "Gender-Neutral", "OPEN-PwD"): 3,
                   ("X", "Civil", "Female-only", "OPEN"): 7}


def test_dynamics_commas(spark, tmp_path):
    path = write(tmp_path, "dyn.csv", ["Year,Registered Applicants,Total Seats", '2024,"15,38,468","59,917"'])
    assert tuple(side_tables.read_dynamics(spark, path).first()) == (2024, 1538468, 59917)


@pytest.mark.parametrize("x", [0.0, 1.5, 2504.754008, 1 / 3, 1e-7, 123456789012.0, -0.25, 1e10, 99999.99999999])
def test_general_number(spark, x):
    got = spark.createDataFrame([(x,)], "v double").select(tables.general_number(F.col("v"))).first()[0]
    assert float(got) == float("%.10g" % x)


def test_dimension_codes_are_dense(spark):
    df = spark.range(500).select(F.concat(F.lit("n"), F.col("id") % 37).alias("name"))
    got = [(r["name"], r["code"]) for r in tables.dimension(df, "name").orderBy("code").collect()]
    assert [c for _, c in got] == list(range(1000, 1037)) and [n for n, _ in got] == sorted(n for n, _ in got)


def test_upload_audit(spark):
    pdf = bytearray(b"%PDF-1.7 body")
    rows = [
        ("../x/a.PDF", pdf, "application/pdf; v=1"), ("a.pdf", bytearray(b"nope"), "application/pdf"), ("a.txt", pdf, "text/plain"),
        ("a.pdf", bytearray(b""), "application/pdf"), ("a.pdf", pdf, "image/png"), ("a.pdf", bytearray(b"%PDF-" + b"x" * 100), "application/pdf"),
        ("dir/", pdf, "application/pdf"), ("p.webp", bytearray(b"RIFF0000WEBPxx"), "image/webp")]
    files = spark.createDataFrame(rows, "name string, content binary, declared_type string")
    got = [(r["safe_name"], r["reason"]) for r in file_audit.audit_uploads(files, 50).collect()]
    assert got == [("a.PDF", None), ("a.pdf", "signature_mismatch"), ("a.txt", "unsupported_extension"), ("a.pdf", "empty"),
                   ("a.pdf", "declared_type_mismatch"), ("a.pdf", "too_large"), ("dir", "unsupported_extension"), ("p.webp", None)]


def test_forward_fill_across_blocks(spark):
    """One long file among short ones: blocks hand values on, files do not."""
    import random

    rng = random.Random(3)
    rows = [("long", i, rng.choice(["", None, " ", f"v{i}"]) if i % 97 == 0 else "", "p" if i == 5 else None) for i in range(3000)]
    rows += [(f"f{k}", i, "x" if i == 1 else "", "") for k in range(5) for i in range(3)] + [(None, 0, "n", ""), (None, 1, "", "")]
    want, last = {}, {}
    for file, i, a, b in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        seen = last.setdefault(file, [None, None])
        seen[0] = a if a and a.strip() else seen[0]
        seen[1] = b if b and b.strip() else seen[1]
        want[file, i] = tuple(seen)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "`the file` string, i int, `Sr. No` string, b string")
    out = cleaning.forward_fill(df, ["Sr. No", "b"], "i", "the file")
    assert out.columns == df.columns
    assert {(r[0], r[1]): (r[2], r[3]) for r in out.collect()} == want
    assert cleaning.forward_fill(df.limit(0), ["b"], "i", "the file").count() == 0


def test_long_seat_rows_are_skipped_and_short_ones_kept(spark, tmp_path):
    path = write(tmp_path, "seats.csv", [
        '"Institute\n Name",Program Name,Seat Pool,OPEN,SC', 'X,"Civil, B",Neutral,"1,200",4', ",,Neutral,1,2,3", ",,Female-only,7"])
    got = {(r["institute"], r["program"], r["seat_pool"], r["category"]): r["seat_count"]
           for r in side_tables.read_seat_matrix(spark, path).collect()}
    assert got == {("X", "Civil, B", "Neutral", "OPEN"): 1200, ("X", "Civil, B", "Neutral", "SC"): 4,
                   ("X", "Civil, B", "Female-only", "OPEN"): 7}


def test_headers_read_a_bounded_head(spark, tmp_path):
    from cutline.sources import file_heads

    write(tmp_path, "2018_round_1.csv", ["a,b,c,d,e,f,g"] + ["x" * 100] * 50_000)
    write(tmp_path, "2018_round_2.csv", ["h" * 9000 + ",b,c,d,e,f", "x"])
    write(tmp_path, "2018_round_3.csv", ["\ufeffa,b\r"])
    open(tmp_path / "2018_round_4.csv", "w").close()
    paths = spark.createDataFrame([(f"file:{tmp_path}/2018_round_{i}.csv",) for i in (1, 2, 3, 4)], "path string")
    rows = {r["path"][-16:]: r for r in file_heads.headers(paths).collect()}
    assert {k: r["width"] for k, r in rows.items()} == {
        "2018_round_1.csv": 7, "2018_round_2.csv": 6, "2018_round_3.csv": 2, "2018_round_4.csv": 1}
    assert rows["2018_round_1.csv"]["bytes_read"] == file_heads.HEAD_BYTES
    assert rows["2018_round_3.csv"]["header"] == "a,b"
    assert file_heads.headers(paths.limit(0)).count() == 0


def test_files_are_audited_where_they_lie(spark, tmp_path):
    import hashlib

    body = {"a.pdf": b"%PDF-" + b"x" * (3 << 20), "b.png": b"nope", "empty.pdf": b"", "new file.pdf": b"%PDF-1"}
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in body.items()], "name string, content binary")
    folder = str(tmp_path / "box")
    assert file_audit.write_files(files, folder) == 4 == file_audit.write_files(files, folder)
    assert sorted(os.listdir(folder)) == sorted(body)
    sha = lambda b: hashlib.sha256(b).hexdigest().upper()
    manifest = spark.createDataFrame(
        [("a.pdf", sha(body["a.pdf"])), ("b.png", sha(b"nopf")), ("empty.pdf", sha(b"")), ("gone.pdf", sha(b"x"))], "name string, sha256 string")
    rows = file_audit.audit_manifest(spark, folder, manifest)
    assert {r["name"]: (r["status"], r["length"]) for r in rows.collect()} == {
        "a.pdf": ("ok", 5 + (3 << 20)), "b.png": ("mismatch", 4), "empty.pdf": ("ok", 0), "gone.pdf": ("missing", None), "new file.pdf": ("unlisted", 6)}
    reasons = file_audit.audit_files(rows.withColumn("declared_type", F.lit("application/pdf")), 4 << 20)
    assert {r["name"]: r["reason"] for r in reasons.collect()} == {
        "a.pdf": None, "b.png": "declared_type_mismatch", "empty.pdf": "empty", "gone.pdf": "empty", "new file.pdf": None}


def test_listing_is_done_by_tasks_and_skips_what_spark_skips(spark, tmp_path, monkeypatch):
    """Folders in folders, empty and hidden files: the same paths as Spark's own listing, without its index in the driver."""
    from cutline.sources import file_audit

    for name in ("a.txt", "b c.txt", "in/x.txt", "in/deep/y.txt", "_k=1/z.txt", ".hidden", "_private", "in/.part", "in/w._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "none").mkdir()
    want = {r.path.replace("file:///", "file:/") for r in file_audit.read_files(spark, str(tmp_path)).select("path").collect()}
    monkeypatch.setattr(file_audit, "LISTED_AT_ONCE", 2)
    got = file_audit.listed(spark, f"{tmp_path}/")
    paths = [r.path for r in got.collect()]
    assert len(paths) == 5 and set(paths) == want
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    assert {r.path for r in file_audit.listed(spark, f"file://{tmp_path}").collect()} == want
