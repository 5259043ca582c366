"""Language ID computes the features of many words at once."""

import zlib

import numpy as np

from churnkit.llm import language_crf


def _by_definition(word, lexicon):
    f = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    e = f"^{word}$"
    f += [e[i:i + 2] for i in range(len(e) - 1)] + [e[i:i + 3] for i in range(len(e) - 2)]
    if word in lexicon:
        f.append(f"L{lexicon[word]}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % language_crf.SLOTS for x in f]


def test_features_of_many_words_follow_the_definition():
    words = ["a", "ab", "abc", "straße", "día", "語", "日本語", "𝔘𝔫𝔦", "x\ud800y", "word"]
    lexicon = {"word": 3, "a": 11}
    flat, starts = language_crf.features_of(words, lexicon)
    assert [x.tolist() for x in np.split(flat, starts[1:])] == [_by_definition(w, lexicon) for w in words]


def test_new_words_are_scored_in_parts_of_bounded_size(monkeypatch):
    model = language_crf.fit([("en", ["the", "house"]), ("de", ["das", "haus"])])
    seen = []
    whole = language_crf.features_of
    monkeypatch.setattr(language_crf, "features_of", lambda words, lexicon: seen.append(len(words)) or whole(words, lexicon))
    text = " ".join("w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(10_000))
    language_crf.Tagger(model).predict([text])
    assert sum(seen) == 10_000 and max(seen) <= 4096
