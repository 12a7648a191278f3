"""Plain Python answers for small inputs, used as expectations."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re

SPACE = " \t\n\x0b\f\r" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
RUNS = re.compile(f"[{SPACE}]+")
SYMBOLS = set("""{}[]()<>;:=_/\\|"'`#$%&*+^~-""")
BLOB = re.compile(r"(?:data:[\w/+.-]+;base64,)?[A-Za-z0-9+/]{500,}={0,2}", re.ASCII)


def units(text: str) -> int:
    return len(text.encode("utf-16-be")) // 2


def head(text: str, count: int) -> str:
    cut = text.encode("utf-16-be")[: 2 * count]
    return cut.decode("utf-16-be", errors="replace")


def tokens(text: str) -> int:
    if not text:
        return 0
    dense = sum(c in SYMBOLS for c in text) / units(text) > 0.08
    return math.ceil(units(text) / (3.2 if dense else 4.0))


def clean(text: str) -> str:
    return RUNS.sub(" ", text)


def digest(text: str) -> str:
    return hashlib.sha1(clean(text).strip(SPACE).encode()).hexdigest()


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def kind_of(block) -> str | None:
    return "string" if isinstance(block, str) else block.get("type") if isinstance(block, dict) else None


# What each kind of block contributes to the rewriter's reading of a message; others add an empty line.
READ = {
    "string": lambda block: block,
    "text": lambda block: block.get("text") or "",
    "tool_use": lambda block: compact(block.get("input", {})),
    "tool_result": lambda block: reading(block.get("content")),
}


def reading(content) -> str:
    """The rewriter's reading of a message's content: a line for each block of a list."""
    if isinstance(content, list):
        return "\n".join(READ.get(kind_of(block), lambda _: "")(block) for block in content)
    return content if isinstance(content, str) else '""' if content is None else compact(content)


def with_text(content, text: str):
    """Content after a rewrite, by the positions of its blocks.

    Of the places that hold text, the first gets the new one; later results say so, later texts go.
    """
    if not isinstance(content, list):
        return text
    alive = [block for block in content if block or isinstance(block, (dict, list))]
    kinds = dict(enumerate(map(kind_of, alive)))
    results, texts = ({i for i, k in kinds.items() if k == name} for name in ("tool_result", "text"))
    if not results | texts:
        return [*alive, {"type": "text", "text": text}]
    first = min(results | texts)
    new = {i: "[removed]" for i in results} | {first: text}
    member = {i: "content" if i in results else "text" for i in new}
    gone = texts - {first}
    return [{**b, member[i]: new[i]} if i in new else b for i, b in enumerate(alive) if i not in gone]


def results_among(messages) -> set[int]:
    """Positions of the messages that carry a tool's result."""
    from_tools = {i for i, m in enumerate(messages) if m.get("role") == "tool"}
    return from_tools | {
        i for i, m in enumerate(messages)
        if isinstance(m.get("content"), list) and "tool_result" in {kind_of(b) for b in m["content"] if isinstance(b, dict)}
    }


def without_blobs(texts, **_) -> dict[int, str]:
    cut = {i: BLOB.sub(f"[{TAG}: base64 blob removed — use file/image APIs instead]", t) for i, t in texts.items()}
    return {i: t for i, t in cut.items() if t != texts[i] and tokens(texts[i]) - tokens(t) > 50}


def without_copies(texts, **_) -> dict[int, str]:
    places: dict[str, set[int]] = {}
    for i in (i for i, t in texts.items() if units(t) >= 300):
        places.setdefault(digest(texts[i]), set()).add(i)
    return {
        i: f"[{TAG}: identical to message #{min(group)} — content removed]"
        for group in places.values() for i in group - {min(group)}
    }


def without_stale_results(texts, results, keep, limit) -> dict[int, str]:
    stale = {i for i in results & set(range(len(texts) - keep)) if tokens(texts[i]) > limit}
    over = {i: units(texts[i]) - 4 * limit for i in stale}
    note = "\n…[{}: trimmed {} chars of stale tool output]".format
    return {i: head(texts[i], 4 * limit) + note(TAG, over[i]) if over[i] > 0 else texts[i] for i in stale}


TAG = "context-shaper"
EDITS = {"strip-base64": without_blobs, "dedupe": without_copies, "trim-tool-results": without_stale_results}


def kept_from(messages, keep) -> int | None:
    """Where the kept tail of a pruned history starts: at no result, and with two messages at least."""
    if len(messages) <= 2 * keep:
        return None
    tail = set(range(len(messages) - keep, len(messages))) - results_among(messages)
    return min(tail) if tail and len(messages) - min(tail) >= 2 else None


def rewrite(messages, strategies, keep, limit):
    """One conversation rewritten: messages, tokens before and after, changes (strategy, position, saved)."""
    before, changes = sum(tokens(reading(m.get("content"))) for m in messages), []
    for name in [name for name in EDITS if name in strategies]:
        texts = {i: reading(m.get("content")) for i, m in enumerate(messages)}
        new = EDITS[name](texts, results=results_among(messages), keep=keep, limit=limit)
        # A copy's whole text counts as saved, whatever the note costs.
        saved = {i: tokens(texts[i]) - (0 if name == "dedupe" else tokens(t)) for i, t in new.items()}
        changes += [(name, i, saved[i]) for i in sorted(new)]
        messages = [{**m, "content": with_text(m.get("content"), new[i])} if i in new else m for i, m in enumerate(messages)]
    start = kept_from(messages, keep) if "prune-history" in strategies else None
    if start is not None:
        total = sum(tokens(reading(m.get("content"))) for m in messages[:start])
        stub = (
            f"[{TAG}: {start} earlier messages (~{total} tokens) pruned. "
            "Replace this stub with an LLM-written summary of those turns for best results.]"
        )
        messages = [{"role": "user", "content": stub}, *messages[start:]]
        changes.append(("prune-history", 0, total - tokens(stub)))
    return messages, before, sum(tokens(reading(m.get("content"))) for m in messages), changes


WORDS = ["alpha", "beta", "{x: 1}", "a_b=c;", "naïve", "日本", "😀", " ", "\n\n", "word " * 30, "QUJD" * 130]


def some_text(rng: random.Random, top: int = 40) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(top)))


def some_conversation(rng: random.Random) -> list[dict]:
    """Messages of every shape, with repeats."""
    pool = [some_text(rng, 120) for _ in range(3)]
    messages = []
    for _ in range(rng.randrange(1, 24)):
        text = rng.choice(pool) if rng.random() < 0.5 else some_text(rng)
        role = rng.choice(["user", "assistant", "tool", "system"])
        shape = rng.randrange(7)
        content = text
        if shape == 1:
            content = [{"type": "text", "text": text}, {"type": "tool_use", "id": "t", "name": "f", "input": {"b": text[:20], "a": 1}}]
        elif shape == 2:
            content = [{"type": "tool_result", "tool_use_id": "t", "content": text}, {"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": text[:9]}]}]
        elif shape == 3:
            content = [{"type": "image", "source": "x"}, {"type": "text", "text": text}, {"type": "text", "text": "tail"}]
        elif shape == 4:
            content = [text, "", None, {"type": "thinking", "thinking": text}]
        elif shape == 5 and rng.random() < 0.3:
            content = None
        messages.append({"role": role, "content": content})
    return messages
