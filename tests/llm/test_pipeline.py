import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import substring

from .test_decontam import words as item_words


def test_stages_against_planted_cases(spark, tmp_path):
    w = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    clean = [(i, w(f"doc{i}x", 60)) for i in range(30)]
    toxic = [(100 + i, w(f"t{i}y", 15) + " vile vile vile vile " + w(f"t{i}z", 15)) for i in range(20)]
    copies = [(200, clean[3][1]), (201, clean[3][1].replace("doc3x50", "changed")), (202, clean[4][1].upper())]
    passage = w("shared", 55)
    repeats = [(300, w("p", 20) + " " + passage), (301, w("q", 30) + " " + passage + " " + w("r", 30)), (302, None), (303, "")]
    item = w("bench", 14)
    leaks = [(400, w("l", 30) + " " + item + " " + w("m", 30))]
    rows = clean + toxic + copies + repeats + leaks
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    others = {i for i, _ in clean + repeats + leaks}
    assert set(seen["toxicity"]) == others | {200, 201, 202}
    assert set(seen["near_duplicates"]) == others
    cut = {i: r.text for i, r in seen["substrings"].items()}
    assert cut[301] == w("q", 30) + " " + w("r", 30) and cut[300] == repeats[0][1] and cut[302] is None and cut[303] == ""
    assert seen["substrings"][301].n_chars == len(cut[301])
    assert set(seen["decontamination"]) == others - {400}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in seen["decontamination"].values())
    packed = docs.collect()
    assert sum(r.length for r in packed) == total and {r.doc_id for r in packed} == others - {400}
    assert corpus_pipeline.run(spark, d).count() == len(packed)
    assert item_words(item) and substring.WINDOW == 20
