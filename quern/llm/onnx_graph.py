"""ONNX models as bytes, for onnxruntime: nodes, constants and named float matrices."""

from __future__ import annotations

import numpy as np
import onnxruntime

_FLOAT, _INTEGER = 1, 7  # of TensorProto.DataType


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(at: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(at << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(at << 3 | 2) + _number(len(raw)) + raw


def node(op: str, inputs: list[str], output: str, domain: str = "", **attributes: int | str) -> bytes:
    """A node of one output."""
    out = b"".join(_field(1, x) for x in inputs) + _field(2, output) + _field(4, op)
    for name, x in attributes.items():
        out += _field(5, _field(1, name) + (_field(3, x) + _field(20, 2) if isinstance(x, int) else _field(4, x) + _field(20, 3)))
    return out + (_field(7, domain) if domain else b"")


def constant(name: str, x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, np.int64 if x.dtype.kind == "i" else np.float32)
    return b"".join(_field(1, n) for n in x.shape) + _field(2, _INTEGER if x.dtype.kind == "i" else _FLOAT) + _field(8, name) + _field(9, x.tobytes())


def _matrix(name: str, rows: str, columns: str | int) -> bytes:
    """A matrix; sizes that are not fixed have names."""
    shape = b"".join(_field(1, _field(1 if isinstance(x, int) else 2, x)) for x in (rows, columns))
    return _field(1, name) + _field(2, _field(1, _field(1, _FLOAT) + _field(2, shape)))


def session(nodes: list[bytes], constants: list[bytes], inputs: dict[str, int], outputs: list[str]) -> onnxruntime.InferenceSession:
    """A session on one thread. inputs: the width of each, all having any same number of rows."""
    graph = b"".join(_field(1, x) for x in nodes) + _field(2, "graph") + b"".join(_field(5, x) for x in constants)
    graph += b"".join(_field(11, _matrix(k, "rows", n)) for k, n in inputs.items()) + b"".join(_field(12, _matrix(k, f"{k}0", f"{k}1")) for k in outputs)
    domains = b"".join(_field(8, _field(1, name) + _field(2, version)) for name, version in (("", 17), ("com.microsoft", 1)))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(_field(1, 8) + _field(7, graph) + domains, options, providers=["CPUExecutionProvider"])
