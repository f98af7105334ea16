import os
import random
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from envspark.llm.common import materialize


def corpus(spark, frame, folder):
    rng = random.Random(12)
    words = {"en": [f"the{a}{b}" for a in "bcdf" for b in "aeiou"], "fr": [f"é{a}{b}x" for a in "bcdf" for b in "aeiou"]}

    def text(lang, n):
        return " ".join(rng.choices(words[lang], k=n))
    item = " ".join(f"answer{i}" for i in range(30))
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(0, None, "en"), (1, "1234 !!", "fr"), (2, "", None)]
    for i in range(3, 120):
        lang = rng.choice(["en", "fr"])
        rows.append((i, text(lang, rng.randrange(20, 150)), None if i % 7 == 0 else lang))
    rows += [(200, rows[10][1], "en"), (201, rows[10][1].upper(), "en"), (202, rows[11][1] + " " + passage, "en"),
             (203, passage + " " + rows[12][1][::-1], "en"), (204, text("en", 40) + " " + item, "en"), (None, text("fr", 50), None)]
    rows = [(d, t, lang, "s", len(t or "")) for d, t, lang in rows]
    frame(rows).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return rows, passage


def test_stages_and_run(spark, frame, tmp_path):
    folder = str(tmp_path)
    rows, passage = corpus(spark, frame, folder)
    by_id = {d: t for d, t, *_ in rows}
    docs = spark.read.parquet(folder + "/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == list(P.COLUMNS)
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe"]
    first = {r.doc_id for r in seen["language_id"]}
    assert first == set(by_id) - {0, 1, 2} and all(r.lang for r in seen["language_id"])
    assert all(r.text == by_id[r.doc_id] for r in seen["language_id"])
    second = {r.doc_id for r in seen["simhash_near_dedup"]}
    assert not second & {200, 201} and 10 in second and {202, 203, 204, None} <= second
    third = {r.doc_id: r for r in seen["suffix_array_dedup"]}
    assert set(third) == second
    raw = {d: by_id[d].encode() for d in second}
    w = P.PASSAGE_BYTES
    count = Counter(b[i:i + w] for b in raw.values() for i in range(len(b) - w + 1))
    for d, b in raw.items():
        gone = {k for i in range(len(b) - w + 1) if count[b[i:i + w]] > 1 for k in range(i, i + w)}
        kept = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        assert third[d].text == kept and third[d].n_chars == len(kept)
    assert "shared30" not in third[202].text and "shared30" not in third[203].text
    fourth = {r.doc_id for r in seen["benchmark_decontamination"]}
    assert fourth == second - {204}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r.doc_id: r for r in seen["bpe"]}
    assert set(last) == fourth
    for d, r in last.items():
        assert r.ids == tok.encode(third[d].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    whole = sorted(((r.doc_id is None, r.doc_id, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, folder).collect()), key=repr)
    assert whole == sorted(((r.doc_id is None, r.doc_id, r.ids_sha256, r.decoded_sha256) for r in seen["bpe"]), key=repr)


def test_passages_of_short_words(spark, frame):
    """Shared passages of 51 to 70 words go, however short the words; shorter ones and clean texts stay."""
    rng = random.Random(8)

    def words(n, size):
        return " ".join("".join(rng.choices("abcdefgh", k=size)) for _ in range(n))
    passages = [words(n, size) for n, size in ((51, 3), (53, 4), (60, 3), (70, 5))]
    assert all(200 <= len(p) < 420 for p in passages)
    small = words(40, 3)
    rows = [(10 * k + j, f"{words(60, 5)} {p} {words(60, 5)}") for k, p in enumerate(passages) for j in range(2)]
    rows += [(100 + j, f"{words(50, 5)} {small} {words(50, 5)}") for j in range(2)] + [(200 + j, words(150, 5)) for j in range(20)]
    got = {r.doc_id: r.text for r in P.stage_suffix_array_dedup(spark, frame(rows), "").collect()}
    for k, p in enumerate(passages):
        for j in range(2):
            assert p not in got[10 * k + j] and p.split()[25] not in got[10 * k + j].split() and len(got[10 * k + j]) >= 700
    assert all(got[d] == t for d, t in rows if d >= 100)


def test_keep_one_of_each_group(spark, frame):
    from envspark.llm.simhash import keep_one
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (3, a), (3, a), (None, a), (7, b), (7, b), (None, "x y z"), (9, a.upper())]
    got = sorted(((r.doc_id, r.text) for r in keep_one(frame(rows)).collect()), key=repr)
    assert got == sorted([(3, a), (7, b), (None, "x y z")], key=repr)


def test_empty_table(spark, frame, tmp_path):
    frame([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_documents_stay_where_no_language_was_learned(spark, frame):
    from envspark.llm.language_id import held_out
    rows = [(i, f"clean text number {i}", None) for i in range(20)] + [(90, None, None), (91, "12 !", None), (92, "", None)]
    got = P.stage_language_id(spark, frame(rows), "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [r[:3] for r in rows[:20]]
    out = frame([(i,) for i in range(60)]).where(held_out(P.F.col("doc_id"))).collect()
    held = [(r.doc_id, f"texte {r.doc_id}", "fr") for r in out] + [(None, "no id", None), (None, "1", None)]
    got = P.stage_language_id(spark, frame(held), "").collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in got), key=repr) == sorted(held[:-1], key=repr)
    named = [(i, f"some words {i}", "und") for i in range(20)]
    assert P.stage_language_id(spark, frame(named), "").count() == 20


def test_clear_disagreement_relabels(spark, frame, tmp_path):
    """A wrong label gives way to a sure prediction; right labels and texts stay."""
    folder = str(tmp_path)
    rows, _ = corpus(spark, frame, folder)
    rng = random.Random(3)
    wrong = [(500 + i, " ".join(f"é{rng.choice('bcdf')}{rng.choice('aeiou')}x" for _ in range(80)), "en", "s", 1) for i in range(3)]
    docs = frame(rows + wrong)
    got = {r.doc_id: (r.lang, r.text) for r in P.stage_language_id(spark, docs, folder).collect()}
    assert all(got[d] == ("fr", t) for d, t, *_ in wrong)
    assert all(got[d] == (lang, t) for d, t, lang, *_ in rows if 3 <= (d or 0) < 120 and lang)
