"""What a worker holds from one operator to the next."""

from __future__ import annotations

import gc
import pickle
import weakref
import zlib

from arborist.llm import language_id, pii, quality_rules
from arborist.llm.language_id import CrossParser


def test_a_worker_holds_one_operators_state_at_a_time():
    references = (("en", b"the cat sat on the mat"), ("fr", b"le chat est la"))
    parser = language_id._parser(references)
    assert language_id._parser(references) is parser  # made once a worker
    seen = weakref.ref(parser)
    del parser
    model = quality_rules._model(zlib.compress(pickle.dumps(CrossParser(references)), 1))
    gc.collect()
    assert seen() is None
    seen = weakref.ref(model)
    del model
    assert list(pii._first(iter([]))) == []
    gc.collect()
    assert seen() is None
