import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from quire.llm import pieces
from quire.llm.pieces import BLANK, Lattice, digest, encode_texts

from .helpers import docs, hard

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def number(field, value):
    return varint(field << 3) + varint(value)


def unigram(pairs):
    """A unigram model with byte pieces, whose normalizer leaves texts as they are but for blanks, in the file format's terms."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in pairs)]
    out = b"".join(message(1, message(1, p.encode()) + varint(21) + struct.pack("<f", s) + number(3, kind)) for p, s, kind in rows)
    return out + message(2, number(3, 1) + number(35, 1)) + message(3, message(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


@pytest.fixture(scope="module")
def fractional(tmp_path_factory):
    chance, path = random.Random(1), tmp_path_factory.mktemp("models") / "unigram.model"
    names = [BLANK, *"abcdé", *{"".join(chance.choices("abcdé", k=chance.randint(2, 5))) for _ in range(60)}]
    names += [BLANK + x for x in names[3:30]]
    path.write_bytes(unigram([(p, -0.1 - 9 * chance.random()) for p in names]))
    return str(path)


def every_path(nbest, text):
    """All segmentations of a short text by brute force: (score, ids)."""
    paths = {0: [(0.0, ())]}
    for j in range(1, len(text) + 1):
        paths[j] = [(s + nbest.pieces[text[i:j]][1], (*ids, nbest.pieces[text[i:j]][2])) for i in range(j) if text[i:j] in nbest.pieces for s, ids in paths[i]]
        if text[j - 1] not in nbest.pieces:
            paths[j] += [(s + nbest.penalty, (*ids, *(nbest.bytes[b] for b in text[j - 1].encode()))) for s, ids in paths[j - 1]]
    return sorted(paths[len(text)], key=lambda x: -x[0])


def rounded(scores):
    return [round(s, 6) for s in scores]


@pytest.mark.parametrize("kind", ["public", "fractional"])
def test_segmentations_equal_enumeration(kind, fractional):
    path, letters = (PATH, "theanios\nr日é ") if kind == "public" else (fractional, "abcdéx日 ")
    for n in (1, 2, 5):
        nbest, chance = Lattice(path, n), random.Random(n)
        for _ in range(80):
            text = "".join(chance.choices(letters, k=chance.randint(1, 9)))
            everything = every_path(nbest, BLANK + text.replace(" ", BLANK))
            found = nbest.segmentations(text)
            assert rounded(s for s, _ in found) == rounded(s for s, _ in everything[:n])
            assert len({ids for _, ids in found}) == len(found) and {ids for _, ids in found} <= {ids for _, ids in everything}
            count, ids, scores, _ = nbest.encode([text])[0]
            assert rounded(scores) == rounded(s for s, _ in found) and count == len(ids) // 4
            assert rounded([{i: s for s, i in everything}[struct.unpack(f"<{count}i", ids)]]) == rounded(scores[:1])


@pytest.mark.parametrize("kind", ["public", "fractional"])
def test_all_of_the_n_best_come_with_identifiers(kind, fractional):
    path, letters = (PATH, "theanios\nr日é ") if kind == "public" else (fractional, "abcdéx日 ")
    for n in (1, 3, 5):
        nbest, chance = Lattice(path, n), random.Random(n)
        texts = ["".join(chance.choices(letters, k=chance.randint(0, 9))) for _ in range(80)]
        for text, (_, ids, scores, _, others) in zip(texts, nbest.encode_all(texts)):
            everything = {i: s for s, i in every_path(nbest, BLANK + text.replace(" ", BLANK))} if text else {(): 0.0}
            ways = [struct.unpack(f"<{len(x) // 4}i", x) for x in (ids, *others)]
            assert len({*ways}) == len(ways) == min(n, len(everything)) == len(scores)
            assert rounded(everything[w] for w in ways) == rounded(scores) == rounded(sorted(everything.values(), reverse=True)[:n])


def test_words_side_by_side_equal_words_alone(monkeypatch):
    chance = random.Random(3)
    texts = ["", "日本 x", "stone" * 30, *(" ".join("".join(chance.choices("theanios日é\U0001f600", k=chance.randint(1, 60))) for _ in range(20)) for _ in range(20))]
    together = Lattice(PATH, 3).encode_all(texts)
    monkeypatch.setattr(pieces, "LANES", 7)
    assert Lattice(PATH, 3).encode_all(texts) == together
    monkeypatch.setattr(pieces, "SHORT", 0)
    for a, b in zip(together, Lattice(PATH, 3).encode_all(texts)):
        assert a[3] == b[3] and rounded(a[2]) == rounded(b[2]) and len(a[4]) == len(b[4])


def test_unigram_models_equal_the_library(fractional):
    library, nbest, chance = sentencepiece.SentencePieceProcessor(model_file=fractional), Lattice(fractional, 4), random.Random(5)
    for _ in range(200):
        text = "".join(chance.choices("abcdé  ", k=chance.randint(1, 30))).strip() or "a"
        best = nbest.segmentations(text)
        whole = {p: s for p, (_, s, _) in nbest.pieces.items()}
        theirs = library.nbest_encode_as_pieces(text, 4)
        assert [round(sum(whole[p] for p in way), 3) for way in theirs] == [round(s, 3) for s, _ in best]
        assert struct.pack(f"<{len(best[0][1])}i", *best[0][1]) == nbest.encode([text])[0][1]


def test_long_lattices_keep_no_edges(monkeypatch):
    nbest, text = Lattice(PATH, 4), "thereinafterwardness" * 5
    kept = nbest.search(text, 4)
    monkeypatch.setattr(pieces, "LONG", 0)
    assert rounded(s for s, _ in nbest.search(text, 4)) == rounded(s for s, _ in kept)
    assert len(nbest.search("stone" * 20_000, 3)) == 3


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{k * 7 + j}x" for j in range(50)) for k in range(200)]
    want = Lattice(PATH, 3).encode(texts)
    monkeypatch.setattr(pieces, "MEMORY", 20_000)
    monkeypatch.setattr(pieces, "ATOMS", 5)
    small = Lattice(PATH, 3)
    assert [small.encode([t])[0] for t in texts] == want and small.encode(texts) == want
    assert len(small.memo) + len(small.old) < 200 and len(small.atom) <= 5


def test_hard_rows_come_back_whole(spark):
    ids, texts = hard()
    texts += ["  two  blanks  ", "tab\tand\nline", "▁sign"]
    ids += [500, 501, 502]
    rows = encode_texts(docs(spark, texts, ids), PATH).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted(ids, key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    numbers = lambda data: [*struct.unpack(f"<{len(data) // 4}i", data)]
    for r in rows:
        own = numbers(r.ids)
        assert len(own) == r.n_pieces and r.scores == sorted(r.scores, reverse=True)
        assert r.exact == (r.doc_id != 502)
        assert library.decode(own) == r.decoded
        assert r.doc_id == 502 or library.encode(r.decoded) == numbers(r.library_ids)
    assert {r.n_pieces for r in rows if r.decoded == ""} == {0}
    assert digest(encode_texts(docs(spark, []), PATH)).collect() == []


def test_next_segmentations_decode_to_the_text(spark):
    ids, texts = hard()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = encode_texts(docs(spark, texts, ids), PATH)
    for r in encoded.collect():
        assert len(r.next_ids) == len(r.scores) - 1
        assert all(library.decode([*struct.unpack(f"<{len(x) // 4}i", x)]) == r.decoded for x in r.next_ids)
    assert all((r.next_sha256 is None) == (r.next_score is None) for r in digest(encoded).collect())
