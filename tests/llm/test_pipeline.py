import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fluxsite.llm import packing, quality_fm, simhash
from fluxsite.llm.common import drop_work_tables, work_root, work_table
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def brute(spark, sf):
    """The pipeline stage by stage in plain Python: {doc_id: times taken}."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    machine = quality_fm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality_fm.score(docs, machine).collect() if r.score >= 0.5}
    last = {}
    for i in sorted(good):
        last[rows[i].text or ""] = i
    prints = {i: brute_print(rows[i].text) for i in last.values()}
    stay = [i for i, c in brute_components(prints).items() if i == c]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or "")) for i in stay}
    by_source = {}
    for i in stay:
        by_source[rows[i].source] = by_source.get(rows[i].source, 0) + size[i]
    from tests.llm.test_mixing import brute_targets

    target = brute_targets(by_source)
    import hashlib

    times = {}
    for i in stay:
        rate = target[rows[i].source] / by_source[rows[i].source]
        draw = int(hashlib.md5(f"mix-1/{i}".encode()).hexdigest()[:13], 16) / 2**52
        times[i] = int(rate) + (draw < rate - int(rate))
    return {i: n for i, n in times.items() if n}, rows


def test_run_equals_brute_force(spark):
    times, rows = brute(spark, SF)
    out = corpus_pipeline.run(spark, SF).collect()
    tokens = packing.Tokens()
    pieces, total = {}, 0
    for r in out:
        ids = tokens.encode(rows[r.doc_id].text or "") + bytes(4)
        assert r.doc_tokens == len(ids) // 4
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        total += r.length
    assert pieces.keys() == times.keys()
    for i, n in times.items():
        size = len(tokens.encode(rows[i].text or "")) // 4 + 1
        assert sum(x for _, x in pieces[i]) == n * size
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    at = 0
    for sequence, offset, n in places:
        assert sequence * 1024 + offset == at
        at += n
    assert at == total


def test_stages_in_order_with_the_columns_of_documents(spark):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({"size": F.lit("extra"), "row": F.lit(1), "fp": F.lit(2)})
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    part = work_table(docs.unionByName(odd), "in")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, part, SF)
        assert out.columns == docs.columns, name
        before, part = part, work_table(out, name)
        if name != "mix":
            assert part.count() <= before.count()
            assert part.exceptAll(before).count() == 0
    assert simhash.keep_one(part).columns == docs.columns


def test_registered_with_the_other_queries():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert queries["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert set(oracles) <= set(queries)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_work_tables_need_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_root(type("S", (), {"sparkContext": Context()})())


def test_work_tables_can_be_dropped(spark):
    df = work_table(spark.range(3), "gone")
    assert df.count() == 3
    drop_work_tables(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
