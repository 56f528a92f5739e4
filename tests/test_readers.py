"""CSV files are split unless a field holds line breaks."""
from ledgerlens.sources import readers as RD


def _write(path, rows):
    with open(path, "w") as f:
        f.write("id,amount,note\n" + "".join(rows))


def test_plain_csv_is_split(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    _write(path, (f'{i},{i / 4},"note, ""{i}"" of a row"\n' for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = RD.load_transactions(spark, path)
        assert df.rdd.getNumPartitions() > 4
        got = {r["id"]: (r["amount"], r["note"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 60_000 and got[41] == (10.25, 'note, "41" of a row') and dict(df.dtypes) == {"id": "bigint", "amount": "double", "note": "string"}


def test_quoted_breaks_are_kept(spark, tmp_path):
    path = str(tmp_path / "breaks.csv")
    _write(path, (f'{i},{i},"first {i}\n\n""second"""\n' for i in range(2000)))
    df = RD.load_transactions(spark, path)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 2000
    assert df.where("id = 7").first()["note"] == 'first 7\n\n"second"'
    assert RD.read_csv(spark, path, multi_line=False).count() > 2000           # what the reader is told holds
