"""A small table of awkward documents."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, kept string, rep string, digest string, slot string, _row string"


def rows():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 120))) for _ in range(40)]
    texts += [texts[0], texts[0] + " ", texts[1].replace(" ", "\n", 3), "", None, " ", "\t\n", "x", "É ünï ß", "two words", "日本語 テキスト。", "a  b", "<|endoftext|> x", "x \n <|endoftext|>", "A b C", "a b c", " ".join(word() for _ in range(30_000)), "​́e", "İI ıi"]
    base = " ".join(word() for _ in range(400))
    texts += [base, base + " tail", base.replace(" ", " zz ", 1)]
    out = [(3 * i, t, ("en", None)[i % 5 == 4], ("a", "b", None)[i % 3], len(t or ""), "x", "y", "z", "d", "s", "r") for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, "no id", "en", "a", 5, *["q"] * 6), (None, None, None, None, None, *[None] * 6), (out[5][0], "same id, other text", "en", "a", 3, *["q"] * 6)]
    rnd.shuffle(out)
    return out
