"""The contracts in plain Python, as slow as they may be."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(v):
    d = [int(x) for x in v if x.isdigit()][::-1]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
       ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: _luhn(m[0])),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(x.isdigit() for x in m[0]) <= 15)]
SECRETS = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
           ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def base_spans(text, rules):
    """[(start, rank, kind, end)], sorted."""
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "", re.A) if ok(m))


def span_text(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def digest(text, rules):
    spans = base_spans(text, rules)
    return {kind: sum(x[2] == kind for x in spans) for kind, _, _ in rules} | {"sha": hashlib.sha256(span_text(spans).encode()).hexdigest(), "text": span_text(spans)}


def words(text):
    return WORD.findall(text or "")
