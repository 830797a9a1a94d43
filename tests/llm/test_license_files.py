"""What the license scan stores: no more files a table than the input has splits, one for the weights."""

from __future__ import annotations

from tidewatch.llm import licenses

SPLITS, SHUFFLED = 3, 40


def test_stored_tables_are_few_and_of_few_files(spark, monkeypatch):
    texts = [f"line {i} of ours\n{licenses.TEMPLATES[i % 13][1]}\nword{i} and word{i + 1} follow" for i in range(300)]
    rows = [(i, f"d{i % 9}/LICENSE" if i % 20 == 0 else f"d{i % 9}/{i}.txt", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n int, path string, text string").repartition(SPLITS)
    plain = {tuple(r) for r in licenses.scan(df).collect()}
    files, stored = {}, licenses.stored

    def counting(table, name):
        out = stored(table, name)
        files[name] = len(out.inputFiles())
        if name == "numbered-files":
            files["splits"] = out.rdd.getNumPartitions()
        return out

    monkeypatch.setattr(licenses, "stored", counting)
    conf = {"spark.sql.shuffle.partitions": str(SHUFFLED), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = {tuple(r) for r in licenses.scan(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain and len(found) == 300 and all(r[1] for r in found)
    assert files["template-weights"] == 1
    most = max(files.pop("splits"), SPLITS)
    assert most < SHUFFLED and len(files) == 5 and all(n <= most for n in files.values()), files


def test_empty_files_have_no_license(spark):
    df = spark.createDataFrame([], "n int, path string, text string")
    assert licenses.scan(df).collect() == []
    assert licenses.matched(df.filter("n is null and n = 1"), "n", "text", df.n == 0).collect() == []
