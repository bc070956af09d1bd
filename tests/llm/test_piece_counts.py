import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import piece_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "\n\n", " \n ", "a\n b", "The  cat\n\nsat   on ", "▁▁a▁b ▁", "<s></s><unk> <0x0A>", "é中文 \U0001f600 ３", "x" * 20000, "word " * 8000, "a\x00b c", "\t\ttab\r\n", "1234 12.5 %%", "    \n    indented",
]


def library(cached=[]):  # noqa: B006
    import sentencepiece

    if not cached:
        cached.append(sentencepiece.SentencePieceProcessor(model_file=PATH))
    return cached[0]


def test_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, " ", 1), (None, "null id", None)]
    got = piece_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library().encode(t or "")), n > 4096) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert piece_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_shortcut_is_used():
    c = piece_counts.counter(PATH)
    assert c.apart and len(c.whole) > 20_000 and c.whole[" the"] == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n▁aest")), max_size=50))
def test_any_text(text):
    assert piece_counts.counter(PATH).count(text) == len(library().encode(text))
