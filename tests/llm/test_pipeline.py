"""Every stage of the pipeline against a plain reference on its own input, and the rows of the whole run."""

import math
import random
from collections import Counter, defaultdict

import brute as B
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the river of stone and light in a field with water for house that is on it".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(PLAIN) + rng.choice(["", "", str(rng.randrange(1000)), ","]) for _ in range(n))
    rows = [(i, text(rng.choice([5, 40, 80, 300])), "en", rng.choice("abc"), 0) for i in range(40)]
    base = text(150)
    rows += [(100 + i, base + f" extra{i}", "en", "a", 0) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", "de", "b", 0), (202, text(60) + " password = hunter22x " + text(5), "en", "c", 0)]
    rows += [(203, "#|%& " * 200, "en", "b", 0), (204, " ".join(f"{x}$" for x in range(5000, 5200)), "en", "b", 0), (205, text(4000), "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def divergence(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    out = 0.0
    for k in {*p, *q}:
        x, y = p[k] / a, q[k] / b
        out += sum(z * math.log2(2 * z / (x + y)) for z in (x, y) if z)
    return math.sqrt(max(0.0, out / 2))


def kept_by_rules(rows):
    from spotframe.llm.features import COMMON
    from spotframe.llm.quality_rules import CHAR_LIMIT, MIN_REFERENCE, MIN_WORDS, WORD_LIMIT

    kinds = {c: k for k, cs in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"()-", "#*$%&|<>"]) for c in cs}
    chars = {r["doc_id"]: Counter(kinds.get(c, 6 if ord(c) < 128 else 7) for c in r["text"] or "") for r in rows}
    words = {r["doc_id"]: Counter(w if w in COMMON else None for w in B.words(B.lower(r["text"]))) for r in rows}
    refs = [defaultdict(Counter), defaultdict(Counter)]
    for r in rows:
        for ref, own in zip(refs, (chars, words), strict=True):
            ref[r["lang"] or ""].update(own[r["doc_id"]])
            ref[None].update(own[r["doc_id"]])
    out = set()
    for r in rows:
        i, n = r["doc_id"], len(B.words(r["text"]))
        lang = r["lang"] or ""
        lang = lang if sum(refs[1][lang].values()) >= MIN_REFERENCE else None
        far = n >= MIN_WORDS and any(divergence(own[i], ref[lang]) > a + b / math.sqrt(n) for ref, own, (a, b) in zip(refs, (chars, words), (CHAR_LIMIT, WORD_LIMIT), strict=True))
        if not far and not B.quality_base(r["text"])[-1]:
            out.add(i)
    return out


def test_stages_and_run(spark, folder):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = zip(*P.STAGES, strict=True)
    assert len(names) == 5
    columns, held = docs.columns, [docs]
    for stage in stages:
        out = stage(spark, held[-1], folder)
        held.append(spark.createDataFrame(out.collect(), out.schema))
    assert all(d.columns == columns for d in held[:-1])
    rows = [d.collect() for d in held]
    ids = [sorted(r["doc_id"] for r in x) for x in rows[:-1]]

    assert set(ids[1]) == kept_by_rules(rows[0]) and {200, 201, 203}.isdisjoint(ids[1])
    groups = B.jaccard([(r["doc_id"], r["text"]) for r in rows[1]])
    assert ids[2] == sorted(i for i, v in groups.items() if v[1] == i) and sum(100 <= i < 120 for i in ids[2]) == 1
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    assert ids[3] == ids[2]
    for r in rows[3]:
        assert sum(B.base_row(r["text"])[:3]) == 0
        assert r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"]
        assert sum(B.base_row(before[r["doc_id"]])[:3]) == 0 or "[SECRET]" in r["text"]
    taken = B.mix([(r["doc_id"], r["source"], r["text"]) for r in rows[3]])
    copies = {i: math.ceil(t / n) for i, n, _, _, t in taken if t}
    assert Counter(ids[4]) == copies
    tokenizer, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r["doc_id"]: r["text"] for r in rows[4]}
    expected = Counter({i: n * math.ceil(len(B.ids_of(tokenizer, text[i], 0)) / 2048) for i, n in copies.items()})
    assert Counter(r["doc_id"] for r in rows[5]) == expected
    whole = P.run(spark, folder)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, rows[5]))


def test_stages_on_repeated_rows_clashes_and_no_rows(spark, folder):
    import corpus_pipeline as P

    rng = random.Random(5)
    text = " ".join(rng.choice(PLAIN) + str(rng.randrange(1000)) for _ in range(80))
    other = " ".join(rng.choice(PLAIN) + str(rng.randrange(1000)) for _ in range(80))
    rows = [(1, text, "en", "a", 0)] * 2 + [(1, other, "en", "a", 0), (None, other + " more", None, None, None), (7, "", "en", "b", 0), (8, None, "en", "b", 0)]
    clash = ["row", "size", "h", "base", "spans", "taken", "digest", "root", "text_key", "row_key", "kept", "ids", "length", "s", "k"]
    docs = spark.createDataFrame(rows, COLUMNS)
    for c in clash:
        docs = docs.withColumn(c, docs["doc_id"] * 0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        ids = Counter(r["doc_id"] for r in out.collect())
        if name == "n-gram jaccard join":
            assert ids == {1: 2, None: 1, 7: 1, 8: 1}
        elif name == "secret scans":
            assert ids == {1: 3, None: 1, 7: 1, 8: 1}
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert P.STAGES[-1][1](spark, docs, folder).count() == 6 and P.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
