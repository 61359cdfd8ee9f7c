import random

import public_tokenizers
from tokenizers import Tokenizer

from kinforge.llm import op2_tokens as op2


def test_maps_compose_in_any_order():
    machine = op2.Transducer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(12)
    for _ in range(60):
        text = "".join(rng.choices("ab'st 19.,é\t\x1c", k=rng.randint(1, 60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text))))
        maps = [((), 0, 0), *(machine.chunk_map(text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)]))]
        left = maps[0]
        for m in maps[1:]:
            left = machine.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = machine.compose(m, right)
        assert left == right == machine.scan(maps)[-1]


def test_long_texts_without_spaces():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, machine = Tokenizer.from_file(path), op2.Transducer(path)
    rng = random.Random(13)
    long = "".join(rng.choices("abcdeilnorst", k=20_000))
    for text in (long, long + " " + long[:9000] + "\n", "!" * 9000, "x y " * 4000, "1" * 5000 + "a"):
        assert machine.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_columns_with_the_names_of_results(spark):
    d = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, n_tokens string, n_bytes int")
    out = op2.count_tokens(d)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_bytes", "over_limit"] and out.first()["n_tokens"] == 2
    assert op2.count_tokens(d.limit(0)).count() == 0
