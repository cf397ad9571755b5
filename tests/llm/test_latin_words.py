"""op3's tokenizer: words of Latin letters beyond ASCII are taken apart as those of ASCII."""

from __future__ import annotations

import random

from tallyloom.llm.tokenizing import TextTokenizer, default_path


def test_latin_words_have_the_library_s_ids_without_a_call_each():
    rng = random.Random(7)
    letters = "abcdeéßñöÀØøÿŁžƺǀɏ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
    tails = ["", "", "", ",", ".\n", "'s", "'", "×", "÷2", "12", "́", "́a", "ª", "ɐ", "漢", " x", "…"]
    texts = [" ".join(word() + rng.choice(tails) for _ in range(200)) for _ in range(20)]
    texts += ["é", " é", "é ", "×é é× a×b ÷é", "l'été d'été. Été\nÉté", "é é́ é"]
    held = TextTokenizer(default_path())
    for text in texts:
        assert held.ids(text).tolist() == held.library.encode(text, add_special_tokens=False).ids
    calls, encode = [], held._encode
    held._encode = lambda t: calls.append(t) or encode(t)
    held.ids(" ".join(word() + "é" + rng.choice(["", ",", "."]) for _ in range(500)))
    assert len(calls) < 20
