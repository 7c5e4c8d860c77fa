import pytest

from kindred.sources.records import RecordError, id_lists, links, read_records, read_truth, read_truth_table, record_views, sample_rows, scored_lists, write_list_file, write_partitioned, write_records, write_scored_outputs, write_truth
from kindred.sources.store import Files, Store
from kindred.streaming.retrieval import stream_candidates


def test_records_keep_order_and_empty_cells(spark, tmp_path):
    p = tmp_path / "s1.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tO'Hara\t1, High St\tUS\n\nS1-2\tकमल\t\tIndia\n")
    rows = read_records(spark, str(p), "S1")
    assert [tuple(r) for r in rows.collect()] == [("S1-1", "O'Hara", "1, High St", "US"), ("S1-2", "कमल", "", "India")]
    views = {r.entity_id: r for r in record_views(rows.toDF("entity_id", "name_raw", "addr_raw", "country")).collect()}
    assert views["S1-2"].name_indic and views["S1-2"].addr_missing and views["S1-1"].name_norm == "o hara"


@pytest.mark.parametrize("body", ["a\tb\n", "entity_id,business_name,business_address,country\n", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\ta\tb\tc\n", "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tc\nS1-1\ta\tb\tc\n"])
def test_broken_records_fail(spark, tmp_path, body):
    p = tmp_path / "bad.tsv"
    p.write_text(body)
    with pytest.raises(RecordError):
        read_records(spark, str(p), "S1")


def test_truth_and_lists(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    truth = read_truth(spark, str(p))
    assert {r.ref_id: r.tgt_ids for r in truth.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    out = id_lists(truth.select("ref_id"), links(truth), "ids")
    assert {r.ref_id: r.ids for r in out.collect()} == {"S1-1": "S2-1,S3-2", "S1-2": ""}


def test_a_wide_row_names_its_line(spark, tmp_path):
    p = tmp_path / "w.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tc\n\nS1-2\ta\tb\n")
    with pytest.raises(RecordError, match="line 4: 3 columns"):
        read_records(spark, str(p), "S1")


def test_truth_ids_are_not_trimmed_and_repeats_fail(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2\n")
    assert read_truth(spark, str(p)).collect()[0].tgt_ids == ["S2-1", " S2-2"]
    for body in ("S1-1\tS2-1\nS1-1\tS2-2\n", "S1-1\tS2-1,S2-1\n"):
        p.write_text("source1_entity_id\tmatched_entity_ids\n" + body)
        with pytest.raises(RecordError):
            read_truth(spark, str(p))


def test_record_table_has_ordinals(spark, tmp_path):
    p = tmp_path / "s1.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"S1-{k:03}\tName {k}\t\tUS\n" for k in range(40, 0, -1)))
    got = write_records(spark, str(p), "S1", f"{tmp_path}/t").orderBy("ordinal").collect()
    assert [(r.ordinal, r.entity_id) for r in got] == [(k, f"S1-{k + 1:03}") for k in range(40)] and got[0].name_norm == "name 1"


def test_truth_table_round_trip(spark, tmp_path):
    rows = {"b": ["x", "y"], "a": []}
    write_truth(spark.createDataFrame(list(rows.items()), "ref_id string, tgt_ids array<string>"), f"{tmp_path}/t")
    assert {r.ref_id: r.tgt_ids for r in read_truth_table(spark, f"{tmp_path}/t").collect()} == rows


def test_scored_outputs_are_these_bytes(spark, tmp_path):
    required = spark.createDataFrame([("S1-2",), ("S1-1",), ("S1-3",)], "ref_id string")
    scored = spark.createDataFrame([("S1-1", "S3-1", False), ("S1-1", "S2-9", True), ("S1-2", "S2-1", False)], "ref_id string, tgt_id string, selected boolean")
    assert write_scored_outputs(required, scored, f"{tmp_path}/o") == 1
    assert (tmp_path / "o/matching_results.tsv").read_bytes() == b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-9\nS1-2\t\nS1-3\t\n"
    assert (tmp_path / "o/candidate_pairs.tsv").read_bytes() == b"source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-9,S3-1\nS1-2\tS2-1\nS1-3\t\n"
    with pytest.raises(RecordError, match="S1-9"):
        scored_lists(required, spark.createDataFrame([("S1-9", "S2-1", True)], "ref_id string, tgt_id string, selected boolean"))


def test_store_reuses_prunes_and_reports(spark, tmp_path):
    store, made = Store(spark, f"file://{tmp_path}/s"), []

    def make():
        made.append(1)
        return spark.range(len(made))

    assert [store.table("a", ["x"], make).count() for _ in range(2)] == [1, 1] and len(made) == 1
    assert store.table("a", ["y"], make).count() == 2 and len(store.files.names(f"{store.root}/a")) == 2
    store.files.write(f"{store.root}/a/manifest.json", b"broken")
    assert store.table("a", ["y"], make).count() == 3
    assert store.report("r", {"k": [1]}) == store.read_report("r") == {"k": [1]}
    store.files.write(f"{tmp_path}/f", b"abc")
    assert Files(spark).digest(f"file://{tmp_path}/f") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "c string, x int")
    write_partitioned(df, f"{tmp_path}/p", "c")
    write_partitioned(df.where("c = 'a'").selectExpr("c", "x + 10 AS x"), f"{tmp_path}/p", "c")
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [2, 11]


def test_samples_are_taken_once(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "entity_id string, x int")
    wanted = spark.createDataFrame([("b",), ("b",), ("c",)], "entity_id string")
    assert [tuple(r) for r in sample_rows(rows, wanted).collect()] == [("b", 2)]


def test_lists_in_one_file(spark, tmp_path):
    write_list_file(spark.createDataFrame([(k, f"v{k}") for k in range(100, 300)], "k int, v string"), f"{tmp_path}/l.tsv", ("k", "v"))
    assert (tmp_path / "l.tsv").read_text() == "k\tv\n" + "".join(f"{k}\tv{k}\n" for k in range(100, 300))


def test_streamed_targets_get_the_same_candidates(spark, tmp_path):
    from kindred.operators.retrieval import candidate_edges

    schema = "src int, rec_id long, country string, name_terms array<string>, addr_terms array<string>"
    rows = [(1, k, "x", ["ab", f"n{k}"], [f"a{k}"]) for k in range(5)] + [(2, 10 + k, "x", [f"n{k}", "zz"], [f"a{k}"]) for k in range(3)]
    both = spark.createDataFrame(rows, schema)
    both.where("src = 2").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(both.schema).parquet(f"{tmp_path}/in")
    stream_candidates(stream, both, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    key = lambda df: sorted((r.tgt_id, r.ref_id, r.v) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(candidate_edges(both)) != []
