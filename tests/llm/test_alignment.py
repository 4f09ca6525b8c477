"""Token alignment against the tokenizers themselves and all pairs of their tokens."""

import collections
import hashlib
import itertools
import random

import pytest

from vigil.llm import alignment, registry


@pytest.fixture(scope="module")
def tokenizers_():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(text, both):
    """Tokens of each encoding as (id, first byte, one past the last), or two empty lists."""
    if not text:
        return [], []
    a, b = both
    shown = {c: k for k, c in alignment.byte_characters().items()}
    as_, bs = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    tokens = [[(i, bytes(shown[c] for c in a.id_to_token(i))) for i in as_], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in bs]]
    if any(b"".join(x for _, x in t) != (" " + text).encode() for t in tokens):
        return [], []
    out = []
    for t in tokens:
        ends = list(itertools.accumulate(len(x) for _, x in t))
        out.append([(i, e - len(x), e) for (i, x), e in zip(t, ends, strict=True)])
    return out[0], out[1]


def by_hand(texts, both):
    rows, counts = [], collections.Counter()
    for t in texts:
        a, b = spans(t, both)
        links = [(i, k) for i, s, e in a for k, u, v in b if s < v and u < e]
        counts.update(links)
        groups, at = [], 0
        for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in x if at < e <= cut) for x in (a, b)))
            at = cut
        rows.append((len(a), len(b), links, groups))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    return [(na, nb, len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "", g) for na, nb, links, g in rows]


def numbers(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def fuzzed(n, seed):
    rng = random.Random(seed)
    chars = " \n\t  \x1c\x85\xa0abcXYZéß漢字ま<unk><s>'ll12½​🙂▁\0́"
    return ["".join(rng.choice(chars if k % 2 else chars.replace("▁", "")) for _ in range(rng.randrange(60))) for k in range(n)]


def test_odd_and_random_texts(spark, tokenizers_, monkeypatch):
    texts = [None, "", " ", "a ", "    ", "<|endoftext|> x <s></s> <0x0A>", "U+2581 ▁ here", *fuzzed(250, 3)] * 2
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(3)
    want = by_hand(texts, tokenizers_)
    got = {r.doc_id: r for r in alignment.token_links(df).collect()}
    assert len(got) == len(texts) and all(numbers(got[k]) == want[k][:-1] for k in got)
    groups = {r.doc_id: r.groups for r in alignment.with_groups(df).collect()}
    for k, t in enumerate(texts):
        assert ["|".join(",".join(map(str, x)) for x in (g.a, g.b)) for g in groups[k]] == want[k][-1]
        assert not groups[k] or (groups[k][0].start == 0 and groups[k][-1].stop == len((" " + t).encode()))
        assert all(x.stop == y.start for x, y in zip(groups[k], groups[k][1:], strict=False))
    assert sum(x[0] > 0 for x in want) > 100 < sum(x[0] == 0 for x in want) + 100
    empty = df.where("false")
    assert alignment.token_links(empty).count() == alignment.with_groups(empty).count() == 0
    with pytest.raises(ValueError, match="n_best"):
        alignment.token_links(df.withColumnRenamed("n_chars", "n_best"))


def test_query_against_brute_force(spark, tiny, tokenizers_, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 1500 OR text IS NULL").select("doc_id", "text").collect()
    want = by_hand([d.text for d in docs], tokenizers_)
    got = {r.doc_id: r for r in alignment.token_links(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert [numbers(got[d.doc_id]) for d in docs] == [w[:-1] for w in want]
    whole = registry.queries()["op13_token_alignment"](spark, tiny).collect()
    assert len(whole) == spark.read.parquet(f"{tiny}/documents.parquet").count()
    by = {r.doc_id: r for r in whole}
    assert [numbers(by[d.doc_id])[:4] for d in docs] == [w[:4] for w in want]


def test_chunks_of_a_task_are_summed(tokenizers_, spark):
    """Chunks end within a task; what is counted is as in one."""
    texts = fuzzed(60, 9) * 3
    want = by_hand(texts, tokenizers_)
    encode = alignment.encoders(alignment.vocabularies())
    x = alignment.Aligned(texts, encode)
    ends = [0, *itertools.accumulate(x.n_links.tolist())]
    pairs = x.pairs().tolist()
    counts = collections.Counter(pairs)
    assert [sum(counts[p] for p in pairs[i:j]) for i, j in itertools.pairwise(ends)] == [w[5] for w in want]
    numbers_ = alignment.unpacked(alignment.packed(x.pairs() & 0xFFFFFFFF))
    assert numbers_.tolist() == [p & 0xFFFFFFFF for p in pairs]


def test_long_texts_without_spaces(spark):
    df = spark.createDataFrame([(1, "x" * 300_000), (2, " " * 100_000), (3, "漢" * 50_000)], "doc_id long, text string")
    assert all(r.n_links >= max(r.n_a, r.n_b) > 0 for r in alignment.token_links(df).collect())
