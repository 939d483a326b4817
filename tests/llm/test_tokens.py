import random

import pytest

from millrace.llm import tokens

from .conftest import as_bag


def brute(model, text):
    """Best segmentation by trying all pieces at all places, ties as documented."""
    if not text:
        return 0.0, 0
    s = tokens.SPACE + text.replace(" ", tokens.SPACE)
    low = min(model.pieces.values()) - tokens.UNKNOWN
    best = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        found = None
        for start in range(end):
            piece = s[start:end]
            if piece in model.pieces:
                c = best[start][0] + model.pieces[piece]
                if found is None or c > found[0]:
                    found = (c, best[start][1] + 1)
        if s[end - 1] not in model.pieces:
            c = best[end - 1][0] + low
            if found is None or c > found[0]:
                found = (c, best[end - 1][1] + len(s[end - 1].encode()))
        best.append(found)
    return best[-1]


def texts(seed, letters, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_ties_and_unknown_characters():
    sp = tokens.SPACE
    model = tokens.Unigram({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -1.5, "aba": -3.0, sp: -1.0, sp + "a": -2.0, sp + sp: -2.0, "bé": -1.0})
    for text in texts(1, "aab bé"):
        assert model.measure(text) == brute(model, text)


def test_against_a_public_implementation():
    tokenizers = pytest.importorskip("tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    every = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    other = tokenizers.Tokenizer(tokenizers.models.Unigram(every, 0, True))
    model = tokens.from_sentencepiece()
    known = ["the ", "quality", " ", "  ", "é", "日本", "\n", "x", "ing", "🎉", "\t", "A"]
    for text in texts(2, known, 600):
        want = len(other.encode(tokens.SPACE + text.replace(" ", tokens.SPACE)).ids) if text else 0
        assert model.measure(text)[1] == want, text


def test_pieces_across_blanks_are_not_cut():
    model = tokens.Unigram({"a": -1.0, tokens.SPACE: -1.0, f"a{tokens.SPACE}a": -0.5})
    assert model.measure("a a") == (-1.5, 2)


def test_odd_rows(odd, odd_rows, nothing):
    model = tokens.from_sentencepiece()
    want = sorted(((r[0], len(r[1] or ""), *reversed(model.measure(r[1] or ""))) for r in odd_rows), key=repr)
    assert as_bag(tokens.count(odd, model)) == want
    assert tokens.count(nothing, model).collect() == []
