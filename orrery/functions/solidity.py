"""Solidity source: comments, functions, ABI types, versions and facts, one text at a time."""

from __future__ import annotations

import re

COMMENT = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)
HEADER = re.compile(r"\b(?:function\s+([A-Za-z_$][\w$]*)|(constructor|fallback|receive))\s*\(([^)]*)\)([^{;]*)([{;])")
CONTRACT = re.compile(r"\b(?:abstract\s+)?(contract|library|interface)\s+([A-Za-z_$][\w$]*)[^{]*\{")
VISIBILITY = ("private", "internal", "external", "public")
VERSION = re.compile(r"v?(\d+)\.(\d+)(?:\.(\d+))?")


def without_comments(source: str | None) -> str:
    """Comments go; what looks like one inside a string stays."""
    return COMMENT.sub(lambda m: m[1] or ("\n" * m[0].count("\n") or " "), source or "")


def closing(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand in no bracket."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == mark and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def abi_type(kind: str) -> str:
    """The canonical name: ``uint`` is ``uint256``, contracts and payable addresses are addresses."""
    base, array = re.fullmatch(r"\s*([^\[\s]+)[^\[]*((?:\s*\[\s*\d*\s*\])*)\s*", kind).groups() if kind.strip() else ("", "")
    known = {"uint": "uint256", "int": "int256", "byte": "bytes1", "fixed": "fixed128x18", "ufixed": "ufixed128x18"}
    base = known.get(base, base)
    if not re.fullmatch(r"(u?int\d+|address|bool|string|bytes\d*|u?fixed\d+x\d+|function|tuple|\(.*\))", base):
        base = "address"
    return base + re.sub(r"\s", "", array)


def parameters(text: str) -> list[tuple[str, str]]:
    """(canonical type, name) of each parameter."""
    out = []
    for p in split_top(text):
        words = [w for w in re.sub(r"\s+(?=\[)", "", p).split() if w not in ("memory", "storage", "calldata", "payable", "indexed")]
        out.append((abi_type(words[0]), words[1] if len(words) > 1 else ""))
    return out


def functions(source: str | None) -> list[dict]:
    """Name, contract, signature, visibility, flags and text of each function."""
    text, found = without_comments(source), []
    contracts = [(m.start(), closing(text, m.end() - 1), m[2]) for m in CONTRACT.finditer(text)]
    for m in HEADER.finditer(text):
        name = m[1] or m[2]
        kinds = ",".join(t for t, _ in parameters(m[3]))
        tail = m[4].split()
        found.append({
            "name": name, "contract": next((n for s, e, n in reversed(contracts) if s <= m.start() < e), None), "signature": f"{name}({kinds})",
            "visibility": next((v for v in VISIBILITY if v in tail), "public"), "is_payable": "payable" in tail, "is_view": "view" in tail or "pure" in tail,
            "text": text[m.start() : closing(text, m.end() - 1) if m[5] == "{" else m.end()],
        })
    return found


def version(text: str) -> tuple[int, int, int] | None:
    m = VERSION.match(text.strip())
    return (int(m[1]), int(m[2]), int(m[3] or 0)) if m else None


def satisfies(candidate: str, pragma: str) -> bool:
    """Whether a version meets a pragma: alternatives by ``||``, conditions beside each other all hold."""
    have = version(candidate)

    def holds(op: str, want: tuple[int, int, int]) -> bool:
        if op == "^":
            upper = (want[0] + 1, 0, 0) if want[0] else (0, want[1] + 1, 0) if want[1] else (0, 0, want[2] + 1)
            return want <= have < upper
        if op == "~":
            return want <= have < (want[0], want[1] + 1, 0)
        return {">=": have >= want, ">": have > want, "<=": have <= want, "<": have < want, "!=": have != want}.get(op, have == want)

    if have is None:
        return False
    return any(all(holds(op, version(v)) for op, v in re.findall(r"(\^|~|>=|<=|!=|>|<|=)?\s*(v?\d+\.\d+(?:\.\d+)?)", part)) for part in pragma.split("||"))


def pragmas(source: str | None) -> list[str]:
    return [p.strip() for p in re.findall(r"(?m)^\s*pragma\s+solidity\s+([^;]+);", without_comments(source))]


def compatible(all_pragmas: list[str], candidates: list[str]) -> list[str]:
    """Candidates that meet every pragma."""
    return [c for c in candidates if all(satisfies(c, p) for p in all_pragmas)]


def facts(code: str | None) -> dict[str, list[str]]:
    """Facts by category: parameters as types and as ``param_i``, guards, writes, events, calls, returns, loops."""
    text = without_comments(code)
    out: dict[str, set[str]] = {}
    add = lambda k, v: out.setdefault(k, set()).add(re.sub(r"\s+", "", v).lower())
    m = HEADER.search(text)
    body = text[m.end() :] if m else text
    alias: dict[str, str] = {}
    if m:
        for i, (kind, name) in enumerate(parameters(m[3])):
            add("abi", f"param_type:{i}:{kind}")
            if name:
                alias[name] = f"param_{i}"
        add("visibility", next((v for v in VISIBILITY if v in m[4].split()), "public"))
        for word in ("payable", "view", "pure"):
            if word in m[4].split():
                add("mutability", word)
    for name, new in alias.items():
        body = re.sub(rf"(?<![\w$.]){re.escape(name)}(?![\w$])", new, body)
    local = set(re.findall(r"\b(?:u?int\d*|address|bool|string|bytes\d*)\s+(?:memory\s+|storage\s+|calldata\s+)?([A-Za-z_$][\w$]*)\s*(?:=|;)", body))
    for g in re.finditer(r"\b(require|assert)\s*\(", body):
        inner, depth, at = "", 1, g.end()
        while at < len(body) and depth:
            depth += (body[at] == "(") - (body[at] == ")")
            inner += body[at] if depth else ""
            at += 1
        add("guard", f"{g[1]}:{split_top(inner)[0] if split_top(inner) else ''}")
    if re.search(r"\brevert\b", body):
        add("guard", "revert")
    for w in re.finditer(r"([A-Za-z_$][\w$]*(?:\s*\[[^\[\]]*(?:\[[^\]]*\][^\[\]]*)*\]|\.[A-Za-z_$][\w$]*)*)\s*(?:=(?!=)|\+=|-=|\*=|/=|\+\+|--)", body):
        root = re.match(r"[A-Za-z_$][\w$]*", w[1])[0]
        if root not in local and not root.startswith("param_"):
            add("state_write", w[1])
    for e in re.findall(r"\bemit\s+([A-Za-z_$][\w$]*)", body):
        add("event", e)
    for c in re.findall(r"\.(call|delegatecall|staticcall|send|transfer|transferFrom|approve|mint|burn)\s*[({]", body):
        add("external_call", c)
    for c in re.findall(r"\b(msg\.sender|msg\.value|block\.timestamp|block\.number|tx\.origin|address\(this\))", body):
        add("environment", c)
    for r in re.findall(r"\breturn\s+([^;]+);", body):
        add("return", r)
    for word in ("if", "for", "while"):
        if re.search(rf"\b{word}\s*\(", body):
            add("control_flow", word)
    return {k: sorted(v) for k, v in sorted(out.items())}


def scaffold(source: str | None) -> list[str]:
    """What makes a text no plausible source: fences, no keyword, unbalanced brackets."""
    text, wrong, stack = without_comments(source), [], []
    if "```" in text:
        wrong.append("markdown_fence")
    if not re.search(r"\b(contract|library|interface|function|constructor|modifier|fallback|receive)\b", text):
        wrong.append("missing_keyword")
    bare = re.sub(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", "", text)
    for c in bare:
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or "([{".index(stack.pop()) != ")]}".index(c):
                wrong.append("unbalanced")
                break
    return wrong + (["unbalanced"] if stack and "unbalanced" not in wrong else [])
