import random

import corpus_pipeline
import public_tokenizers
from conflux.llm import langid, minhash
from tokenizers import Tokenizer

from tests.llm import test_minhash, test_packing, test_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-dedup", "mixing", "packing"]
    now = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        rows = now.collect()
        seen.append(rows)
        now = spark.createDataFrame(rows, docs.schema)
    quality, language, deduped, mixed = seen

    everything = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    score = test_quality.llr(everything, good)
    assert {r.doc_id for r in quality} == {d for d, t in everything if not test_quality.brute(t)[-1] and score[d] >= -0.25}
    assert {r.doc_id for r in language} == {r.doc_id for r in quality}  # no text here is without letters

    groups = test_minhash.brute([(r.doc_id, r.text) for r in language], 5, 80)
    assert sorted(r.doc_id for r in deduped) == sorted(d for d, (_, component, _) in groups.items() if component == d)

    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= {r.doc_id for r in deduped} and max(times.values()) <= 3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.pack(spark, now, SF).collect()
    test_packing.check_layout(packed)
    text = {r.doc_id: r.text for r in mixed}
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {d: n * len(test_packing.encode(text[d], tokenizer)) for d, n in times.items()}
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()
    )


def test_stage_edge_cases(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, f"{long} more", "en", "s", 9), (None, long, "en", "s", 9), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "1 2 " * 30, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(minhash.deduplicated(docs).select("doc_id").collect(), key=str)
    assert [r.doc_id for r in kept] == [1, 3, 4, 5, None]
    assert minhash.deduplicated(docs).columns == docs.columns
    assert langid.known(docs, langid.train([(long, "en"), ("la le les des une pour", "fr")] * 40)).count() == 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_text_of_no_learned_language_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rnd = random.Random(5)
    odd = []
    for at, letters in enumerate(["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]):
        odd += [(10**9 + 20 * at + i, " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(80))) for i in range(20)]
    foreign = spark.createDataFrame(odd, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(foreign, allowMissingColumns=True), SF).select("doc_id").collect()]
    assert sorted(d for d in kept if d < 10**9) == sorted(r.doc_id for r in docs.collect())
    assert sum(d >= 10**9 for d in kept) <= len(odd) // 10
