import random

import public_tokenizers
from tokenizers import Tokenizer

from quire.llm.token_counts import BytePairCounter, count_tokens

from .helpers import by_id, docs, hard

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library_on_odd_strings():
    library, own, chance = Tokenizer.from_file(PATH), BytePairCounter(PATH), random.Random(3)
    letters = [*"ab c\n\t \x1c\x85  é²Ⅷ٣'sll日本!?", "<|endoftext|>", "   ", "​"]
    texts = ["".join(chance.choices(letters, k=chance.randint(0, 60))) for _ in range(4000)] + ["x" * 5000, "<|endoftext|>" * 3, "<|endoftext"]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_leave_the_lowest_rank_first():
    own = BytePairCounter(PATH)
    assert own.pretoken("the") == 1 and own.pretoken("") == 0 and own.pretoken("\x00") == 1


def test_hard_rows(spark):
    ids, texts = hard()
    library = Tokenizer.from_file(PATH)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    expected = sorted(((i, len((t or "").encode()), k, k > 512) for i, t, k in zip(ids, texts, n)), key=repr)
    assert by_id(count_tokens(docs(spark, texts, ids), PATH)) == expected
    assert count_tokens(docs(spark, []), PATH).collect() == []
