import random
import struct

from censora.llm import bpe

POOL = [chr(c) for c in (*range(0x300), 0x3000, 0x2003, 0x2028, 0x180E, 0x200B, 0x4E00, 0x661, 0x2167, 0x1F600, 0x1D7D8, 0x93E, 0x301, 0x2460)]


def test_ids_are_those_of_the_library(tokenizer, tokenizer_path):
    coder, pick = bpe.vocabulary(tokenizer_path), random.Random(1)
    for k in range(1500):
        text = "".join(pick.choice(POOL) if pick.random() < 0.5 else pick.choice(" 'stredvml\n\tab12.") for _ in range(pick.randint(0, 60)))
        if k % 5 == 0:
            text = f"{text[:9]}<|endoftext|>{text[9:]}"
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", coder.encode(text))) == want, text
        assert coder.decode(coder.encode(text)).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_very_long_words(tokenizer, tokenizer_path):
    coder = bpe.vocabulary(tokenizer_path)
    for text in ("a" * 50_000, "ab" * 25_000, "xyzzy" * 9_000):
        assert len(coder.encode(text)) // 4 == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_a_full_cache_starts_a_new_generation():
    made = []
    cache = bpe.Recent(lambda k: made.append(k) or k.encode(), 2)
    assert [cache[k] for k in ("a", "b", "c", "a", "d", "e")] == [b"a", b"b", b"c", b"a", b"d", b"e"]
    assert len(cache) <= 2 and made.count("a") == 1


def test_awkward_rows(clashing, tokenizer, tokenizer_path):
    ids = bpe.encode(clashing, tokenizer_path)
    back = bpe.decode(ids, tokenizer_path, keep=("doc_id", "ids"))
    got = sorted((r["doc_id"] or 0, bytes(r["ids"]), r["text"]) for r in back.collect())
    texts = [(r["doc_id"] or 0, r["text"] or "") for r in clashing.collect()]
    want = sorted((i, struct.pack(f"<{len(x)}I", *x), t) for i, t in texts for x in [tokenizer.encode(t, add_special_tokens=False).ids])
    assert got == want


def test_empty_table(documents, tokenizer_path):
    assert bpe.decode(bpe.encode(documents.limit(0), tokenizer_path), tokenizer_path).collect() == []
