"""The skip-chain field on a number that is said very often and found once."""

from __future__ import annotations

import numpy as np
import pytest

from testimony.llm import skipchain_pii
from testimony.llm.skipchain_pii import KINDS, LABELS, N_FEATURES, SkipChain, base_spans, tokens_of

BARE, FULL = "2025550143", "+1 (202) 555-0143"


def said(before: int, after: int) -> str:
    return " then we ring ".join([BARE] * before + [FULL] + [BARE] * after)


@pytest.mark.parametrize("before, after", [(30, 30), (30, 0), (0, 30), (300, 300)])
@pytest.mark.parametrize("bias", [0.0, 0.5])
def test_mentions_far_from_the_found_one_are_labelled(before, after, bias):
    node = np.zeros((N_FEATURES, LABELS))
    node[0, 0] = bias
    field = SkipChain(node, np.zeros((LABELS, LABELS)), np.diag(np.full(LABELS, skipchain_pii.AGREEMENT)))
    text = said(before, after)
    t = tokens_of([(0, text, base_spans(text))])
    p = field.marginals(t)
    bare = [i for i in range(len(t.doc)) if text[t.start[i] : t.end[i]] == BARE]
    assert len(bare) == before + after and (p[bare, KINDS.index("phone") + 1] >= skipchain_pii.SURE).all()


def test_a_text_is_labelled_alike_whatever_stands_beside_it():
    rng = np.random.default_rng(4)
    chain = rng.normal(size=(LABELS, LABELS))
    field = SkipChain(rng.normal(size=(N_FEATURES, LABELS)), chain + chain.T, np.diag(np.full(LABELS, 2.0)))
    texts = [said(1, 1), said(40, 3), "call 5551234 or 5551234 5551234", said(0, 5)]
    together = tokens_of([(i, x, base_spans(x)) for i, x in enumerate(texts)])
    p = field.marginals(together)
    for i, x in enumerate(texts):
        assert np.allclose(p[together.doc == i], field.marginals(tokens_of([(0, x, base_spans(x))])), rtol=0, atol=1e-12)


def test_trained_field_finds_all_of_them(docs_of):
    text = said(30, 30)
    corpus = docs_of(*[f"write to user{i}@mail.example or +1 (303) 555-{1000 + i} from 10.0.0.{i % 200} about {i * 7919}" for i in range(300)], text, said(0, 1))
    rows = {r.doc_id: r for r in skipchain_pii.find_personal_data(corpus, skipchain_pii.train(corpus.where("doc_id <> 300"))).collect()}
    assert [text[s.start : s.end] for s in rows[300].added] == [BARE] * 60 and {s.kind for s in rows[300].added} == {"phone"}
