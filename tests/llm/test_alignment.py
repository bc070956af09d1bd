import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
TEXTS = [
    None, "", " ", "\n", " \n ", "the cat sat on the mat.", "The  cat\n\nsat   on ", "a▁b", "▁", "a\0b", "<s> </s> <unk> <0x0A>", "<|endoftext|> <|endoftext|>", "é中文字 \U0001f600\U0001f680 ３ Ａ", "ſtraße İ ǅ ﬁ",
    "x" * 3000, "ab" * 1500, "-" * 999, "word " * 2000, "1234567890" * 30, "\r\n\t tab", "ไทยภาษา العربية עברית", "    indented\n        more", "the cat sat on the mat.", "don't can't I'll", "\x85 　",
]


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in SHOWN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def tokens(a, b, text):
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [(i, bytes(BYTE_OF[c] for c in a.id_to_token(i))) for i in ids_a]
    of_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
    whole = (" " + text).encode()
    return (of_a, of_b) if b"".join(x for _, x in of_a) == whole == b"".join(x for _, x in of_b) else ([], [])


def groups_of(of_a, of_b):
    ends = lambda x: np.cumsum([len(p) for _, p in x]).tolist()
    ends_a, ends_b = ends(of_a), ends(of_b)
    common = sorted(set(ends_a) & set(ends_b))
    out = [([], []) for _ in common]
    for side, tokens_, ends_ in ((0, of_a, ends_a), (1, of_b, ends_b)):
        for (i, _), e in zip(tokens_, ends_, strict=True):
            out[next(k for k, c in enumerate(common) if c >= e) if len(common) < 50 else int(np.searchsorted(common, e))][side].append(i)
    return out


def brute(docs):
    a, b = sides()
    rows, held = [], Counter()
    for doc_id, text in docs:
        groups = groups_of(*tokens(a, b, text))
        links = Counter()
        for x, y in groups:
            for (i, n), (j, m) in ((p, q) for p in Counter(x).items() for q in Counter(y).items()):
                links[(i, j)] += n * m
        held.update(links.keys())
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = [(d, n_a, n_b, g, sum(x.values()), sum(n for p, n in x.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x.items()), s) for d, n_a, n_b, g, x, s in rows]
    return sorted(out, key=str), held, most


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "the cat"), (None, "no id"), (None, None), (5, "the cat sat on the mat.")] + [(100 + i, f"the cat number {i} sat on {TEXTS[i % 14]} mat") for i in range(60)]


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    frame = spark.createDataFrame([(*d, 1, "x") for d in DOCS], SCHEMA + ", block int, n_a string").repartition(parts)
    made = alignment.align(frame, A, B)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(made) == brute(DOCS)[0]


def test_shares_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARE", 1)  # each block adds up alone first
    frame = spark.createDataFrame(DOCS, SCHEMA).repartition(9)
    assert got(alignment.align(frame, A, B)) == brute(DOCS)[0]
    _, held, most = brute(DOCS)
    assert got(alignment.partners(frame, A, B)) == sorted(((i, j, n, n == most[i]) for (i, j), n in held.items()), key=str)


def test_text_ids_and_empty_table(spark):
    frame = spark.createDataFrame([("a", "the cat"), ("b", None)], "id string, body string")
    assert [r[:5] for r in got(alignment.align(frame, A, B, "id", "body"))] == [("a", 2, 2, 2, 2), ("b", 0, 0, 0, 0)]
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert got(alignment.align(spark.createDataFrame([(1, None)], SCHEMA), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_slices_give_the_same(monkeypatch):
    both = alignment.aligner(A, B)
    texts = [t for _, t in DOCS]
    want = both.block(texts)
    for links, large, chunk in ((1, 64, 16_000), (50, 3, 1), (1 << 22, 0, 0), (1 << 22, 1 << 40, 100)):
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        monkeypatch.setattr(alignment, "LINKS", links)
        monkeypatch.setattr(alignment, "LARGE", large)
        found = both.block(texts)
        assert all(np.array_equal(found[k], want[k]) for k in want)


def test_far_common_ends():
    """A group with tens of millions of links is listed by distinct ids."""
    both = alignment.aligner(A, B)
    one = np.array([220] * 9000 + [262] * 9000)
    a, b = np.zeros(18000, np.int64), np.zeros(12000, np.int64)
    keys, links = both.pairs(one, np.repeat([5, 6, 7], 4000), a, b, np.array([18000]), np.array([12000]), np.array([0]))
    assert links.tolist() == [36_000_000] * 6 and len(keys) == 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t▁aest'．　é")), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    both, (a, b) = alignment.aligner(A, B), sides()
    for text in texts:
        want = tokens(a, b, text)
        units = [u if type(u) is str else u[0] for u in both.units(text)]
        made = [both.tokens(u) for u in units]
        right = all(m[2] for m in made)
        assert [[i for m in made for i in m[side].tolist()] if right else [] for side in (0, 1)] == [[i for i, _ in x] for x in want]
        assert "".join(units) == (" " + text if text else "")
    found = both.block(texts)
    groups = [groups_of(*tokens(a, b, t)) for t in texts]
    assert found["n_groups"].tolist() == list(map(len, groups)) and found["n_links"].tolist() == [sum(len(x) * len(y) for x, y in g) for g in groups]
    assert found["distinct"].tolist() == [len({(i, j) for x, y in g for i in x for j in y}) for g in groups]


def test_packing():
    numbers, links = np.array([0, 5, 70_000, 1, 2**31]), np.array([1, 1, 300, 255, 2**33])
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(numbers, links))] == [numbers.tolist(), links.tolist()]
