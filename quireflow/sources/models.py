"""Models by path: a directory names the factory that makes a model and what it is given.

Encoders, tokenizers and summarisers are factories that workers call once.  A
saved model is a small file, model.json; weights lie wherever its arguments say.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from functools import partial

from quireflow.sources.readers import _system
from quireflow.sources.sinks import write_text


def factory(name: str) -> Callable:
    """What module:attribute names."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError("name a factory as module:attribute")
    return getattr(importlib.import_module(module), attribute)


def save_model(directory: str, name: str, **arguments: object) -> str:
    """Write what load_model reads; the factory must be there and the arguments must be JSON."""
    factory(name)
    path = f"{directory.rstrip('/')}/model.json"
    write_text(path, json.dumps({"factory": name, "arguments": arguments}, indent=2))
    return path


def load_model(directory: str) -> Callable[[], object]:
    """The saved model's factory with its arguments, to be called by each worker."""
    system, name = _system(f"{directory.rstrip('/')}/model.json")
    with system.open_input_stream(name) as file:
        told = json.loads(file.read())
    return partial(factory(told["factory"]), **told["arguments"])
