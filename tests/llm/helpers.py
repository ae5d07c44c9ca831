import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=None, lang=None):
    """documents of these texts, with ids from 0."""
    pick = lambda x, i: x[i] if isinstance(x, list) else x
    return spark.createDataFrame([(i, t, pick(lang, i), pick(source, i), len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, letters="aeioustrnlmdpk"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edited(rng, text, share):
    out = words(text)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = prose(rng, 1)
    return " ".join(out)


def rng(seed=5):
    return random.Random(seed)
