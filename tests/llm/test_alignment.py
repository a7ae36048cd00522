from __future__ import annotations

import hashlib
import os
from collections import Counter

import pytest

from spanloom.llm import alignment

from .corpora import clashing, docs

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="no tokenizers here")


def plain_tokens(text):
    """(id, bytes) of both sides, by the plain encoders, or nothing."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(os.path.join(alignment.FOLDER, alignment.FILE_A))
    a.encode_special_tokens = True
    pieces = {v: k for k, v in a.get_vocab(with_added_tokens=False).items()}
    value = alignment._byte_values()
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(alignment.FOLDER, alignment.FILE_B))
    if not text:
        return [], []
    side_a = [(i, bytes(value[c] for c in pieces[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (side_a, side_b) if b"".join(x for _, x in side_a) == whole == b"".join(x for _, x in side_b) else ([], [])


def brute(texts):
    """A row per text, by comparing every range with every other."""
    found = []
    for t in texts:
        sides = []
        for tokens in plain_tokens(t):
            at, ranges = 0, []
            for i, x in tokens:
                ranges.append((i, at, at + len(x)))
                at += len(x)
            sides.append(ranges)
        a, b = sides
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = ["|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b)) for low, high in zip([0, *cuts], cuts)]
        found.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    held = Counter(p for _, _, _, links, _ in found for p in set(links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(a, b, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if a else "") for a, b, g, links, s in found]


TEXTS = [
    None, "", " ", "Hello world, it's 2024!", "  two  spaces \n\n new\tlines  ", "Straße über naïve café", "日本語のテキスト 한국어", "🙂🙃 zero​width", "<|endoftext|> </s> <unk> <0x41>",
    "under▁line", "ﬁ ligature Å", "a" * 300, "x\x00y\x7f", "aaaa bbbb aaaa bbbb", "Hello world", "мир, мир", "١٢٣ ४५६", " " * 40 + "end", "the the the theatre",
]


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("hot", [alignment.HOT, 3])
def test_digest_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "SLICES", 2)
    monkeypatch.setattr(alignment, "BUCKET", 200)
    assert rows(alignment.digest(docs(spark, TEXTS))) == [(i, *r) for i, r in enumerate(brute(TEXTS))]


def test_repeated_rows_extra_columns_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICES", 1)
    d = docs(spark, [(1, "one two"), (1, "one two"), (None, "one"), (None, "one"), (1, "three")])
    want = brute(["one two", "one", "three"])
    got = [tuple(r)[1:] for r in alignment.digest(clashing(d)).orderBy("doc_id", "n_a", "groups_sha256").collect()]
    assert sorted(got) == sorted([want[0], want[0], want[1], want[1], want[2]])
    assert alignment.digest(d.filter("false")).count() == 0


def test_both_encoders_of_a_agree_on_every_code_point():
    from tokenizers import Tokenizer

    encode, _ = alignment.encoder_a(os.path.join(alignment.FOLDER, alignment.FILE_A))
    model = Tokenizer.from_file(os.path.join(alignment.FOLDER, alignment.FILE_A))
    model.encode_special_tokens = True
    texts = [" " + "".join(f"a{c}b1{c}2. {c} {c}{c}'s" for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) < 0xE000) for at in range(0, 0x110000, 64)]
    assert encode(texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_no_table_stays(spark):
    before = {t.name for t in spark.catalog.listTables()}
    alignment.digest(docs(spark, ["a few words"])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_text_has_the_tokens_of_its_pieces(spark):
    (encode_a, _), (encode_b, _) = alignment._tables(alignment.FOLDER, alignment.FILE_A, alignment.FILE_B)
    assert alignment.cuts_apply(alignment.FOLDER, alignment.FILE_A, alignment.FILE_B)
    around = ["a", "Z9", "'s", "--", "日", "é", "\n", "\t", "\x1c", "\x85", "\xa0", "　", " ", "​", "🙂", "\x00", " ", "  ", "   "]
    texts = [t for t in TEXTS if t and "▁" not in t] + [x + s + y + s + z for x in around for y in around for z in ("b", "", "\n") for s in (" ", "  ")]
    for t in texts:
        pieces = alignment.cut(t)
        assert " ".join(pieces) == t
        assert [i for x in encode_a([" " + p for p in pieces]) for i in x] == encode_a([" " + t])[0], repr(t)
        assert [i for x in encode_b(pieces) for i in x] == encode_b([t])[0], repr(t)
        twice = [i for p in pieces * 2 for i in encode_a([" " + p])[0]]
        assert [i for x in alignment._side_a(encode_a, pieces * 2, True) for i in x] == twice, repr(t)


def test_a_piece_is_exploded_once_a_block(spark, monkeypatch):
    seen = []
    plain = alignment.met
    monkeypatch.setattr(alignment, "SLICES", 1)
    monkeypatch.setattr(alignment, "met", lambda tokens, lengths: seen.append(plain(tokens, lengths).count()) or plain(tokens, lengths))
    texts = ["the cat sat on the mat"] + [f"the cat sat on the mat the cat {'sat' * (i % 2)}".rstrip() for i in range(50)] + ["bad ▁ cat", "new ▁ words", "words new cat"]
    assert rows(alignment.digest(docs(spark, texts))) == [(i, *r) for i, r in enumerate(brute(texts))]
    assert sum(seen) < 40  # 54 texts of six words and more


@pytest.mark.parametrize("cuts", [True, False])
def test_many_blocks_in_few_tasks(spark, monkeypatch, cuts):
    monkeypatch.setattr(alignment, "SLICES", 2)
    monkeypatch.setattr(alignment, "BUCKET", 300)
    monkeypatch.setattr(alignment, "_even", lambda spark, buckets: spark.range(0).selectExpr("id AS at", "id AS block"))  # none found: blocks share buckets
    monkeypatch.setattr(alignment, "cuts_apply", lambda *_: cuts)
    texts = [" ".join(TEXTS[(i * j) % len(TEXTS)] or "" for j in range(1, 5)) for i in range(40)]
    assert rows(alignment.digest(docs(spark, texts))) == [(i, *r) for i, r in enumerate(brute(texts))]
