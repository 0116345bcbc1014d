"""Ids of chunks against the whole tokenizer."""

import random

from tidewire.llm import packing

ODD = [
    "Éviqueré, Straße. ÀÖØÞ ÿŸ × ÷ ñ'S it's IT'LL ve've", "H\u0331 I\u0307 A\u030a e\u0301 E\u0301.", "<|endoftext|> <|ENDOFTEXT|> a<b <|é|>", "\u212a \u212b \u0130 \u1e9e", ".,., ., ,é. ...É,,, a.b,c.",
    "naïve—DÉJÀ\u00a0vu\u2028x\x85y\x1fz", "ß5é٣ª º ²", "ДОМ дом Ελλάς 東京,", "", " \t\n",
]


def test_ids_are_those_of_the_whole_tokenizer():
    of, rng = packing.ChunkTokenizer(packing.default_path()), random.Random(5)
    letters = "aAeEzZéÉßñÑÿÖ.,'-<|>59\u0331\u0301 \u00a0×÷дŸ"
    for text in ODD + ["".join(rng.choice(letters) for _ in range(60)) for _ in range(400)]:
        assert of.ids(text.encode()) == packing.pack_ids(of._tokenizer.encode(text, add_special_tokens=False).ids), text


def test_words_with_accents_go_to_the_model():
    of = packing.ChunkTokenizer(packing.default_path())
    want = packing.pack_ids(of._tokenizer.encode("Éviqueré, Straße. C'était", add_special_tokens=False).ids)
    of._tokenizer = None
    assert of.ids("Éviqueré, Straße. C'était".encode()) == want
