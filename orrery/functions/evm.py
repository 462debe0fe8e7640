"""EVM byte code: instructions, blocks, edges, graph facts and three-address code, one contract at a time.

Everything is driven by one table of operations: how many words an operation takes, what text it stands for, and
whether it leaves a word. The DataFrame side is in ``orrery.operators.evm``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

# Names of operations by byte.
NAMES = {
    0x00: "STOP", 0x01: "ADD", 0x02: "MUL", 0x03: "SUB", 0x04: "DIV", 0x05: "SDIV", 0x06: "MOD", 0x07: "SMOD", 0x08: "ADDMOD",
    0x09: "MULMOD", 0x0A: "EXP", 0x0B: "SIGNEXTEND", 0x10: "LT", 0x11: "GT", 0x12: "SLT", 0x13: "SGT", 0x14: "EQ", 0x15: "ISZERO",
    0x16: "AND", 0x17: "OR", 0x18: "XOR", 0x19: "NOT", 0x1A: "BYTE", 0x1B: "SHL", 0x1C: "SHR", 0x1D: "SAR", 0x20: "SHA3",
    0x30: "ADDRESS", 0x31: "BALANCE", 0x32: "ORIGIN", 0x33: "CALLER", 0x34: "CALLVALUE", 0x35: "CALLDATALOAD", 0x36: "CALLDATASIZE",
    0x37: "CALLDATACOPY", 0x38: "CODESIZE", 0x39: "CODECOPY", 0x3A: "GASPRICE", 0x3B: "EXTCODESIZE", 0x3C: "EXTCODECOPY",
    0x3D: "RETURNDATASIZE", 0x3E: "RETURNDATACOPY", 0x3F: "EXTCODEHASH", 0x40: "BLOCKHASH", 0x41: "COINBASE", 0x42: "TIMESTAMP",
    0x43: "NUMBER", 0x44: "PREVRANDAO", 0x45: "GASLIMIT", 0x46: "CHAINID", 0x47: "SELFBALANCE", 0x48: "BASEFEE", 0x49: "BLOBHASH",
    0x4A: "BLOBBASEFEE", 0x50: "POP", 0x51: "MLOAD", 0x52: "MSTORE", 0x53: "MSTORE8", 0x54: "SLOAD", 0x55: "SSTORE", 0x56: "JUMP",
    0x57: "JUMPI", 0x58: "PC", 0x59: "MSIZE", 0x5A: "GAS", 0x5B: "JUMPDEST", 0x5C: "TLOAD", 0x5D: "TSTORE", 0x5E: "MCOPY", 0x5F: "PUSH0",
    0xF0: "CREATE", 0xF1: "CALL", 0xF2: "CALLCODE", 0xF3: "RETURN", 0xF4: "DELEGATECALL", 0xF5: "CREATE2", 0xFA: "STATICCALL",
    0xFD: "REVERT", 0xFE: "INVALID", 0xFF: "SELFDESTRUCT",
} | {0x60 + i: f"PUSH{i + 1}" for i in range(32)} | {0x80 + i: f"DUP{i + 1}" for i in range(16)} | {0x90 + i: f"SWAP{i + 1}" for i in range(16)} | {0xA0 + i: f"LOG{i}" for i in range(5)}

# Symbols of operations on two words; the deeper word is written first.
SYMBOLS = {
    "ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/", "SDIV": "s/", "MOD": "%", "SMOD": "s%", "EXP": "**", "SIGNEXTEND": "signextend", "LT": "<",
    "GT": ">", "SLT": "s<", "SGT": "s>", "EQ": "==", "AND": "&", "OR": "|", "XOR": "^", "BYTE": "byte", "SHL": "<<", "SHR": ">>", "SAR": "sar",
}
CONTEXT = (
    "ADDRESS ORIGIN CALLER CALLVALUE CALLDATASIZE CODESIZE GASPRICE RETURNDATASIZE COINBASE TIMESTAMP NUMBER "
    "PREVRANDAO GASLIMIT CHAINID SELFBALANCE BASEFEE BLOBBASEFEE GAS PC MSIZE"
).split()
# What is taken, the text with {0} for the top word, and whether a word is left.
TEXTS: dict[str, tuple[int, str, bool]] = (
    {n: (2, f"{{1}} {s} {{0}}", True) for n, s in SYMBOLS.items()}
    | {n: (0, n.lower(), True) for n in CONTEXT}
    | {n: (1, f"{n.lower()}({{0}})", True) for n in ("BALANCE", "EXTCODESIZE", "EXTCODEHASH", "BLOCKHASH", "BLOBHASH")}
    | {n: (3, f"{n.lower()}({{2}}, {{1}}, {{0}})", True) for n in ("ADDMOD", "MULMOD")}
    | {n: (2, f"{a}[{{0}}] = {{1}}", False) for n, a in (("MSTORE", "memory"), ("MSTORE8", "memory8"), ("SSTORE", "storage"), ("TSTORE", "transient_storage"))}
    | {n: (1, f"{a}[{{0}}]", True) for n, a in (("MLOAD", "memory"), ("SLOAD", "storage"), ("TLOAD", "transient_storage"), ("CALLDATALOAD", "calldata"))}
    | {n: (3, f"copy[{{0}}] = {n[:-4].lower()}[{{1}}:{{2}}]", False) for n in ("CALLDATACOPY", "CODECOPY", "RETURNDATACOPY")}
    | {f"LOG{i}": (2 + i, f"log{i}(" + ", ".join(["memory[{0}:{1}]", *[f"topic{k}={{{k + 2}}}" for k in range(i)]]) + ")", False) for i in range(5)}
    | {n: (k, f"{n.lower()}({{1}})", True) for n, k in (("CALL", 7), ("CALLCODE", 7), ("DELEGATECALL", 6), ("STATICCALL", 6))}
    | {
        "ISZERO": (1, "!({0})", True), "NOT": (1, "~({0})", True), "SHA3": (2, "keccak256(memory[{0}:{1}])", True),
        "MCOPY": (3, "memory[{0}] = memory[{1}:{2}]", False), "EXTCODECOPY": (4, "copy[{1}] = extcode({0})[{2}:{3}]", False),
        "CREATE": (3, "create(create({0}, memory[{1}:{2}]))", True), "CREATE2": (4, "create2(create2({0}, memory[{1}:{2}], {3}))", True),
        "JUMP": (1, "goto {0}", False), "JUMPI": (2, "if {1} goto {0}", False), "RETURN": (2, "return memory[{0}:{1}]", False),
        "REVERT": (2, "revert memory[{0}:{1}]", False), "STOP": (0, "stop()", False), "SELFDESTRUCT": (1, "selfdestruct({0})", False),
        "INVALID": (0, "invalid()", False),
    }
)
ENDS = frozenset(("JUMP", "JUMPI", "RETURN", "REVERT", "STOP", "SELFDESTRUCT", "INVALID"))
HALTS = ENDS - {"JUMP", "JUMPI"}
PASSED = frozenset(f"{n}{i}" for n in ("DUP", "SWAP") for i in range(1, 5))
# Where the metadata that compilers append begins, codes of panics, selectors of built-in errors.
METADATA = ("a165627a7a7230", "a2646970667358", "a265627a7a7231", "a264697066735822")
PANICS = {0x00: "generic", 0x01: "assertion failed", 0x11: "arithmetic overflow or underflow", 0x12: "division by zero", 0x21: "invalid enum value",
          0x22: "invalid storage byte array", 0x31: "pop on empty array", 0x32: "array index out of bounds", 0x41: "out of memory", 0x51: "uninitialized function pointer"}
ERROR, PANIC = "08c379a0", "4e487b71"
FARTHEST = 100_000  # constants above it are no jump targets
DEEPEST, AGAIN = 1024, 128  # words of a stack, visits of a block


@dataclass
class Op:
    pc: int
    name: str
    operand: str | None = None

    @property
    def value(self) -> int | None:
        return int(self.operand, 16) if self.operand else 0 if self.name == "PUSH0" else None


@dataclass
class Block:
    start: int
    ops: list[Op]
    successors: list[int] = field(default_factory=list)
    predecessors: list[int] = field(default_factory=list)

    @property
    def id(self) -> str:
        return f"block_{self.start:04x}"


def clean(code: str | None) -> str:
    """Hex digits in lower case, without prefix and appended metadata."""
    digits = re.sub("[^0-9a-f]", "", (code or "").strip().lower().removeprefix("0x"))
    for mark in METADATA:
        if (at := digits.find(mark)) > 0:
            return digits[:at]
    return digits


def disassemble(code: str | None) -> list[Op]:
    """The instructions of clean hex; a cut constant at the end is kept as far as it goes."""
    raw = bytes.fromhex(c[: len(c) // 2 * 2]) if (c := clean(code)) else b""
    ops, at = [], 0
    while at < len(raw):
        b = raw[at]
        name = NAMES.get(b, f"UNKNOWN_{b:02X}")
        n = b - 0x5F if 0x60 <= b <= 0x7F else 0
        ops.append(Op(at, name, raw[at + 1 : at + 1 + n].hex() if n else None))
        at += 1 + n
    return ops


def is_push(op: Op) -> bool:
    return op.name.startswith("PUSH")


def block_starts(ops: list[Op]) -> list[int]:
    """The first instruction, every jump destination, and what follows an instruction that ends a block."""
    if not ops:
        return []
    follow = {b.pc for a, b in zip(ops, ops[1:]) if a.name in ENDS and a.name != "JUMP"}
    pushed: set[int] = set()
    for i, op in enumerate(ops):
        if is_push(op) and op.value is not None and op.value <= FARTHEST:
            for later in ops[i + 1 : i + 5]:
                if later.name in ("JUMP", "JUMPI"):
                    pushed.add(op.value)
                if later.name not in PASSED:
                    break
    after_end = {b.pc for a, b in zip(ops, ops[1:]) if a.name in ENDS}
    return sorted({ops[0].pc} | {o.pc for o in ops if o.name == "JUMPDEST"} | follow | (pushed & after_end))


def blocks(ops: list[Op]) -> dict[int, Block]:
    """Blocks by start, with edges: the last constant of a block is its jump's target; code after a jump without a block start is dead and left out."""
    starts = block_starts(ops)
    index = {o.pc: i for i, o in enumerate(ops)}
    out: dict[int, Block] = {}
    for k, s in enumerate(starts):
        stop = index[starts[k + 1]] if k + 1 < len(starts) else len(ops)
        own = ops[index[s] : stop]
        end = next((i for i, o in enumerate(own) if o.name in ENDS), len(own) - 1)
        out[s] = Block(s, own[: end + 1])
    for b in out.values():
        last = b.ops[-1]
        targets = []
        if last.name in ("JUMP", "JUMPI"):
            push = next((o for o in reversed(b.ops[:-1]) if is_push(o)), None)
            targets += [push.value] if push is not None else []
        at = index[last.pc] + 1
        if last.name != "JUMP" and last.name not in HALTS and at < len(ops):
            targets.append(ops[at].pc)
        for t in targets:
            if t in out and t not in b.successors:
                b.successors.append(t)
                out[t].predecessors.append(b.start)
    return out


def reachable(graph: dict[int, Block], entry: int) -> set[int]:
    seen, todo = set(), [entry] if entry in graph else []
    while todo:
        if (at := todo.pop()) not in seen:
            seen.add(at)
            todo += graph[at].successors
    return seen


def loop_heads(graph: dict[int, Block], entry: int) -> set[int]:
    """Targets of edges back to a block on the depth-first path from the entry."""
    heads, state, path = set(), {}, [(entry, iter(graph[entry].successors))] if entry in graph else []
    if path:
        state[entry] = 1
    while path:
        at, rest = path[-1]
        for t in rest:
            if state.get(t) == 1:
                heads.add(t)
            elif t not in state:
                state[t] = 1
                path.append((t, iter(graph[t].successors)))
                break
        else:
            state[at] = 2
            path.pop()
    return heads


def dominators(graph: dict[int, Block], entry: int) -> dict[int, set[int]]:
    """Blocks that every path from the entry passes; a block without predecessors has itself only."""
    dom = {b: {b} if b == entry or not graph[b].predecessors else set(graph) for b in graph}
    moved = True
    while moved:
        moved = False
        for b in sorted(graph):
            if b != entry and graph[b].predecessors:
                new = {b} | set.intersection(*[dom[p] for p in graph[b].predecessors])
                moved, dom[b] = moved or new != dom[b], new
    return dom


def selectors(ops: list[Op]) -> list[tuple[str, int]]:
    """(selector, entry) of a dispatcher: a four-byte constant compared for equality before a conditional jump to a constant."""
    found = []
    for i, op in enumerate(ops):
        if op.name == "PUSH4":
            rest = [o for o in ops[i + 1 : i + 6] if o.name not in PASSED]
            if len(rest) >= 3 and rest[0].name == "EQ" and is_push(rest[1]) and rest[2].name == "JUMPI":
                found.append((f"0x{op.operand}", rest[1].value))
    return list(dict.fromkeys(found))


def functions(ops: list[Op], graph: dict[int, Block]) -> list[tuple[str, str | None, int]]:
    """(name, selector, entry): those of the dispatcher, else one fallback at the first instruction."""
    found = [(f"function_{s}", s, e) for s, e in selectors(ops) if e in graph]
    return sorted(found, key=lambda x: (x[2], x[0])) or ([("fallback", None, ops[0].pc)] if ops else [])


def effect(op: Op) -> tuple[int, int]:
    """Words taken and left."""
    kind = re.sub(r"\d+$", "", op.name)
    n = int(op.name[len(kind) :] or 0)
    if kind == "PUSH":
        return 0, 1
    if kind == "DUP":
        return n, n + 1
    if kind == "SWAP":
        return n + 1, n + 1
    if op.name == "POP":
        return 1, 0
    taken, _, leaves = TEXTS.get(op.name, (0, "", False))
    return taken, int(leaves)


def stack_heights(graph: dict[int, Block], entry: int) -> dict[int, int]:
    """Words on the stack where each block starts: the most over its predecessors, bounded, with bounded visits."""
    height, visits, todo = {entry: 0}, defaultdict(int), [entry] if entry in graph else []
    while todo:
        b = todo.pop(0)
        visits[b] += 1
        if visits[b] > AGAIN:
            continue
        h = height[b]
        for op in graph[b].ops:
            taken, left = effect(op)
            h = min(DEEPEST, max(0, h - taken) + left)
        for t in graph[b].successors:
            if h > height.get(t, -1):
                height[t] = h
                todo.append(t)
    return {b: height.get(b, 0) for b in graph}


def revert_text(ops: list[Op], at: int) -> str | None:
    """What a revert reports, if a built-in error's selector is among the constants shortly before it."""
    near = [o for o in ops[max(0, at - 20) : at] if is_push(o) and o.operand]
    for o in reversed(near):
        if ERROR in o.operand:
            return "revert Error(string)"
        if PANIC in o.operand:
            code = next((c.value for c in reversed(near) if c.pc != o.pc and len(c.operand) == 2 and c.value in PANICS and c.pc > o.pc), None)
            return "revert Panic(uint256)" if code is None else f"revert Panic({code:#x})  // {PANICS[code]}"
    return None


def three_address(graph: dict[int, Block], entry: int, ops: list[Op]) -> dict[int, list[str]]:
    """Lines of each block, in order of address; temporaries count through the contract.

    A block starts with the words its stack holds there, named after the block; what lies deeper is an underflow.
    """
    index, heights, counter, out = {o.pc: i for i, o in enumerate(ops)}, stack_heights(graph, entry), 0, {}
    for start in sorted(graph):
        stack = [f"phi_{start:04x}_{i}" for i in range(heights[start])]
        lines = []
        for op in graph[start].ops:
            kind = re.sub(r"\d+$", "", op.name)
            n = int(op.name[len(kind) :] or 0)
            if op.name == "JUMPDEST":
                continue
            if kind == "SWAP":
                if len(stack) > n:
                    stack[-1], stack[-1 - n] = stack[-1 - n], stack[-1]
                continue
            if op.name == "POP":
                if stack:
                    stack.pop()
                continue
            if kind in ("PUSH", "DUP"):
                text = ("0x" + op.operand if op.operand else "0") if kind == "PUSH" else stack[-n] if len(stack) >= n else "stack_underflow"
                leaves = True
            elif op.name in TEXTS:
                taken, pattern, leaves = TEXTS[op.name]
                text = pattern.format(*[stack.pop() if stack else "stack_underflow" for _ in range(taken)])
                if op.name == "REVERT":
                    text = revert_text(ops, index[op.pc]) or text
            else:
                lines.append("// nop")
                continue
            if leaves:
                counter += 1
                stack.append(f"temp_{counter}")
                text = f"temp_{counter} = {text}"
            lines.append(text)
        out[start] = lines
    return out


# Groups of operations.
GROUPS = (
    ("calldata", "CALLDATALOAD CALLDATASIZE CALLDATACOPY"), ("caller_context", "CALLER ORIGIN"), ("call_value", "CALLVALUE"),
    ("address_balance", "ADDRESS BALANCE SELFBALANCE"),
    ("block_context", "BASEFEE BLOBBASEFEE BLOBHASH BLOCKHASH CHAINID COINBASE GASLIMIT NUMBER PREVRANDAO TIMESTAMP"),
    ("code_introspection", "CODESIZE CODECOPY EXTCODESIZE EXTCODECOPY EXTCODEHASH"), ("returndata", "RETURNDATASIZE RETURNDATACOPY"),
    ("gas", "GAS GASPRICE"), ("create", "CREATE CREATE2"), ("create2", "CREATE2"), ("delegatecall", "DELEGATECALL"),
    ("external_call", "CALL CALLCODE STATICCALL"), ("selfdestruct", "SELFDESTRUCT"), ("push0", "PUSH0"), ("storage", "SLOAD SSTORE"),
    ("event_log", "LOG0 LOG1 LOG2 LOG3 LOG4"), ("control_flow", "JUMP JUMPI JUMPDEST"), ("revert", "REVERT INVALID"),
)


def keccak256(data: bytes) -> bytes:
    """Keccak with the original padding, of which a selector is the first four bytes."""
    mask = (1 << 64) - 1
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask if n else x
    offsets, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        offsets[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    rounds, lfsr = [], 1
    for _ in range(24):
        rc = 0
        for j in range(7):
            if lfsr & 1:
                rc |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        rounds.append(rc)
    rate = 136
    padded = bytearray(data) + b"\x01" + b"\x00" * ((rate - (len(data) + 1) % rate) % rate)
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        for rc in rounds:
            c = [a[i][0] ^ a[i][1] ^ a[i][2] ^ a[i][3] ^ a[i][4] for i in range(5)]
            d = [c[(i - 1) % 5] ^ turn(c[(i + 1) % 5], 1) for i in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for i in range(5):
                for j in range(5):
                    b[j][(2 * i + 3 * j) % 5] = turn(a[i][j] ^ d[i], offsets[i, j])
            a = [[b[i][j] ^ (~b[(i + 1) % 5][j] & b[(i + 2) % 5][j] & mask) for j in range(5)] for i in range(5)]
            a[0][0] ^= rc
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def selector(signature: str) -> str:
    return "0x" + keccak256(signature.encode())[:4].hex()
