import gc

from eraloom.llm import common, packing
from eraloom.llm.common import collector_off, forget, tokenizer_path


def test_collections_of_a_batch_leave_out_what_was_there_before():
    """Modules hold some hundred thousand objects; a worker collects after every batch."""
    with collector_off():
        assert gc.get_freeze_count() > 10_000 and not gc.isenabled()
    assert not gc.get_freeze_count() and gc.isenabled()


def test_nothing_kept_is_nothing_to_give_back(monkeypatch):
    """Placing calls it for each of its groups."""
    calls = []
    monkeypatch.setattr(common.gc, "collect", lambda: calls.append(1))
    forget()
    calls.clear()
    forget()
    assert not calls
    packing._encoder(tokenizer_path())
    forget()
    assert calls and not packing._encoder.cache_info().currsize
