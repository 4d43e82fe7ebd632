"""Providers outside the engine: models kept in a local folder, and a summariser that a program on this machine may offer."""

from __future__ import annotations

import ipaddress
import json
import os
import urllib.request
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import urlsplit


def threads(asked: int = 0) -> int:
    """Threads of a model: what is asked for, else one for each processor but one."""
    return asked if asked > 0 else max(1, (os.cpu_count() or 2) - 1)


@lru_cache(maxsize=4)
def load_model(folder: str, name: str, opener: Callable[[str, int], object] | None = None, asked_threads: int = 0) -> object:
    """A model of a local folder, opened once a process. Nothing is ever fetched: a model that isn't there is an error that says where it belongs."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        raise FileNotFoundError(f"the model {name} is not in {folder}; put it there, as models are not downloaded")
    return (opener or _onnx)(path, threads(asked_threads))


def _onnx(path: str, count: int) -> object:
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = count
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def is_loopback(endpoint: str) -> bool:
    host = urlsplit(endpoint).hostname or ""
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return host == "localhost"


class LocalSummariser:
    """Summaries by a program on this machine, off unless made. Where it doesn't answer, `fallback` does, and is counted."""

    def __init__(self, endpoint: str, model: str, fallback: Callable[[str], str], timeout: float = 120.0):
        if not is_loopback(endpoint):
            raise ValueError("texts may only go to this machine")
        self.endpoint, self.model, self.fallback, self.timeout, self.fallbacks = endpoint.rstrip("/"), model, fallback, timeout, 0

    def __call__(self, text: str) -> str:
        body = json.dumps({"model": self.model, "prompt": f"Summarise in two sentences:\n\n{text}", "stream": False}).encode()
        request = urllib.request.Request(f"{self.endpoint}/api/generate", body, {"Content-Type": "application/json"})
        direct = urllib.request.build_opener(urllib.request.ProxyHandler({}))
        try:
            with direct.open(request, timeout=self.timeout) as answer:
                said = str(json.load(answer).get("response", "")).strip()
        except (OSError, ValueError):
            said = ""
        if said:
            return said
        self.fallbacks += 1
        return self.fallback(text)
