import random

from pyspark.sql import functions as F

from pulseloom.sources.line_files import read_lines
from pulseloom.sources.market_files import read_file


def test_lines_of_split_files(spark, tmp_path):
    """Several tasks read one file; the numbers are those of reading it whole, whatever the line ends, lengths and blank lines."""
    rng = random.Random(6)
    texts = {}
    for i in range(5):
        lines = [rng.choice(["", "x", "é" * rng.randrange(300), "{\"a\": 1}", "y" * 9000, "tab\tend\r"]) for _ in range(rng.randrange(1, 400))]
        text = rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])
        (tmp_path / f"f{i}.jsonl").write_bytes(text.encode())
        texts[f"f{i}.jsonl"] = text
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("no")
    most = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "4k")
    try:
        rows = read_lines(spark, str(tmp_path), "*.jsonl")
        one = read_lines(spark, str(tmp_path / "f1.jsonl"))
        scan = spark.read.option("lineSep", "\n").text(str(tmp_path / "f1.jsonl")).withColumn("p", F.spark_partition_id())
        assert scan.select("p").distinct().count() > 2
    finally:
        spark.conf.set(most, before)
    got = {}
    for r in rows.collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], {})[r.pos] = r.line
    for name, text in texts.items():
        want = text.split("\n")
        want = [w.removesuffix("\r") for w in (want[:-1] if want[-1] == "" else want)]
        assert [got[name][i] for i in range(len(want))] == want and len(got[name]) == len(want)
    assert one.count() == len(got["f1.jsonl"])
    assert read_file(spark, str(tmp_path / "f1.jsonl")).filter("raw['a'] = '1'").count() == sum(x == '{"a": 1}' for x in got["f1.jsonl"].values())
