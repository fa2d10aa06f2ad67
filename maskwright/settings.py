"""Masking settings: a frozen value compiled into the plan on the driver, with self-healing JSON reading."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Toggles default to on; lists are plain values matched without case; ``custom_patterns`` are Python regular expressions."""

    enabled: bool = True
    mask_passwords: bool = True
    mask_secrets: bool = True
    mask_emails: bool = True
    mask_phones: bool = True
    mask_private_ip: bool = True
    mask_public_ip: bool = True
    mask_domains: bool = True
    mask_ports: bool = True
    mask_databases: bool = True
    mask_hashes: bool = True
    allowed_domains: tuple[str, ...] = ()
    allowed_ips: tuple[str, ...] = ()
    custom_patterns: tuple[str, ...] = ()
    double_layer: bool = True
    ml_enabled: bool = False
    ml_threshold: float = 0.75
    ml_version: str | None = None

    @property
    def bypass(self) -> bool:
        """Nothing can be found: protection is off, or every category is off and no custom pattern is set."""
        toggles = (self.mask_passwords, self.mask_secrets, self.mask_emails, self.mask_phones, self.mask_private_ip, self.mask_public_ip, self.mask_domains, self.mask_ports, self.mask_databases, self.mask_hashes)
        return not self.enabled or not any(toggles) and not self.custom_patterns

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)})

    @classmethod
    def from_json(cls, text: str | None) -> Settings:
        """Missing, malformed or mistyped values read as the defaults; unknown keys are ignored."""
        try:
            raw = json.loads(text or "")
        except ValueError:
            return cls()
        if not isinstance(raw, dict):
            return cls()
        known = {}
        for f in fields(cls):
            value, default = raw.get(f.name), getattr(cls, f.name)
            if isinstance(default, bool) and isinstance(value, bool):
                known[f.name] = value
            elif isinstance(default, tuple) and isinstance(value, list):
                known[f.name] = tuple(str(v) for v in value)
            elif f.name == "ml_threshold" and isinstance(value, (int, float)) and not isinstance(value, bool):
                known[f.name] = float(value)
            elif f.name == "ml_version" and isinstance(value, str):
                known[f.name] = value
        return cls(**known)
