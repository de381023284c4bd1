import random

_WORDS = {
    "en": "the of and house river field garden stone wind water morning through which their would about think light".split(),
    "de": "der und das nicht garten stein wasser morgen durch welche würde über denken licht straße schön fluss".split(),
}


def sentences(n, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        out.append((" ".join(r.choice(_WORDS[lang]) for _ in range(r.randint(8, 30))), lang))
    return out


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)]
