import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from epiloom.llm import decontamination, toxicity
from epiloom.llm.common import table

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LINE = "This very line stands in many documents and says nothing of its own."
BAD = ["blighter", "scoundrel", "rotter"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted cases, and what is to become of each."""
    rng, docs, labels, fate = random.Random(5), [], [], {}
    words = [f"word{i}" for i in range(4000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(prose(25))) for k in range(5)]
    base = prose(120)
    for d in range(420):
        text = prose(rng.randint(40, 120))
        kind = "clean"
        if d % 6 == 0:
            kind = "toxic"
            for _ in range(6):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        elif d % 35 == 1:
            kind, text = "copy", [*base[:60], f"own{d}", *base[60:]]
        elif d % 35 == 2:
            kind, text = "leak", [*text, *items[d % 5][1].split()]
        out = " ".join(text)
        if d % 10 == 3:
            out = LINE + "\n" + out
        docs.append((d, out, "en", f"s{d % 3}", len(out)))
        labels.append((d, 1, int(kind == "toxic")))
        fate[d] = kind
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    fate |= {1000: "clean", 1001: "clean"}
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, fate


def test_planted_cases_go_and_clean_documents_stay(spark, corpus):
    path, docs, fate = corpus
    got = corpus_pipeline.run(spark, path).collect()
    copies = [d for d, k in fate.items() if k == "copy"]
    stay = {d for d, k in fate.items() if k == "clean"} | {min(copies)}
    assert {r.doc_id for r in got} == stay
    last = max(d for d, t, *_ in docs if t and t.startswith(LINE) and fate[d] != "toxic")
    text = {d: (t or "") if d == last or not (t or "").startswith(LINE) else t[len(LINE) + 1 :] for d, t, *_ in docs}
    bins = {}
    for r in got:
        ids = np.array([*LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == np.cumsum([0, *(n for _, n in sorted(held))])[:-1].tolist()


def test_stages_return_documents(spark, corpus):
    path, docs, fate = corpus
    frame = table(spark, path, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, path)
        assert out.dtypes == frame.dtypes
    clean = corpus_pipeline.drop_repeated_lines(spark, frame, path).filter("n_chars <> length(text)")
    assert clean.count() == 0


def test_each_stage_alone(spark, corpus):
    path, docs, fate = corpus
    frame = table(spark, path, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    every = ids(frame)
    assert every - ids(corpus_pipeline.keep_clean(spark, frame, path)) == {d for d, k in fate.items() if k == "toxic"}
    assert every - ids(corpus_pipeline.decontaminate(spark, frame, path)) == {d for d, k in fate.items() if k == "leak"}
    copies = {d for d, k in fate.items() if k == "copy"}
    assert every - ids(corpus_pipeline.one_of_each_group(spark, frame, path)) == copies - {min(copies)}
    assert decontamination.LEAST <= 0.5 and toxicity.THRESHOLD == 0.7


def test_rows_without_and_with_repeated_ids(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n=80: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = text(25)
    base, other, alone = text(), text(), text()
    copy = lambda t, k: f"{t} own{k}"
    clean = [(None, text()), (None, text()), (7, text()), (9, text()), (None, None), (None, ""), (8, None)]
    groups = [(3, base), (None, copy(base, 1)), (7, copy(base, 2)), (5, other), (5, other), (None, alone), (None, copy(alone, 1)), (None, alone)]
    leaks = [(None, f"{text(30)} {item}"), (9, f"{text(30)} {item}")]
    path = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in clean + groups + leaks], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert rows(corpus_pipeline.decontaminate(spark, docs, path)) == sorted(clean + groups, key=repr)
    kept = rows(corpus_pipeline.one_of_each_group(spark, docs, path))
    for d, t in [*clean, *leaks, (3, base), (5, other)]:
        assert kept.count((d, t)) == 1
    assert len(kept) == len(clean) + len(leaks) + 3 and sum(t in (alone, copy(alone, 1)) for _, t in kept) == 1
