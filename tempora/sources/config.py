"""Settings from YAML-like text with environment references, and weights of domains."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

REFERENCE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")
#: What a new domain starts from.
DEFAULT_GAMMA = {"variance_boundary": 100, "low_variance": 70, "high_variance": 85}


def interpolate(value: object, env: Mapping[str, str] | None = None) -> object:
    """`${NAME}` and `${NAME:-default}` in every string; a name that is set but empty stays empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return REFERENCE.sub(lambda m: env.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    return value


def load(path: str, env: Mapping[str, str] | None = None) -> dict:
    """Settings of a JSON file, or of a YAML file where a YAML parser is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return interpolate(json.loads(text), env)
    import yaml  # an optional extra

    return interpolate(yaml.safe_load(text) or {}, env)


def save(path: str, settings: dict) -> None:
    """Write settings as JSON, or as YAML where the name says so and a YAML parser is installed."""
    if path.endswith(".json"):
        text = json.dumps(settings, indent=2, ensure_ascii=False)
    else:
        import yaml  # an optional extra

        text = yaml.safe_dump(settings, allow_unicode=True, sort_keys=False)
    Path(path).write_text(text, encoding="utf-8")


def weights_of(settings: dict, domain: str, alpha: float = 0.6, beta: float = 0.2) -> tuple[float, float]:
    found = settings.get("domains", {}).get(domain, {})
    return float(found.get("alpha", alpha)), float(found.get("beta", beta))


def with_weights(settings: dict, domain: str, alpha: float, beta: float) -> dict:
    """Settings with the domain's weights at three decimals; its gamma table is kept, or begun."""
    domains = dict(settings.get("domains", {}))
    own = dict(domains.get(domain, {}))
    own |= {"alpha": round(alpha, 3), "beta": round(beta, 3)}
    own.setdefault("gamma_matrix", dict(DEFAULT_GAMMA))
    return settings | {"domains": domains | {domain: own}}
