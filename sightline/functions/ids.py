"""Deterministic ids of objects, from the properties that make them what they are."""

from __future__ import annotations

import json
import uuid

#: The namespace, the properties that count for each type, the order of hash kinds.
NAMESPACE = uuid.UUID("00abedb4-aa42-466c-9c01-fed23315a9b7")
CONTRIBUTING = {
    "artifact": ("hashes", "payload_bin"), "autonomous-system": ("number",), "directory": ("path",), "domain-name": ("value",), "email-addr": ("value",),
    "email-message": ("from_ref", "subject", "body"), "file": ("hashes", "name", "extensions", "parent_directory_ref"), "ipv4-addr": ("value",),
    "ipv6-addr": ("value",), "mac-addr": ("value",), "mutex": ("name",),
    "network-traffic": ("start", "end", "src_ref", "dst_ref", "src_port", "dst_port", "protocols", "extensions"), "process": ("x_unique_id",),
    "software": ("name", "cpe", "swid", "vendor", "version"), "url": ("value",), "user-account": ("account_type", "user_id", "account_login"),
    "x509-certificate": ("hashes", "serial_number"), "x-oca-asset": ("host_id", "device_id", "name", "hostname"),
}
HASHES = ("MD5", "'SHA-1'", "'SHA-256'", "'SHA-512'")
PROCESS_IDS = ("process_id", "process_uid", "process_unique_id", "process_guid")


def _hash(hashes: dict) -> dict | None:
    if not hashes:
        return None
    kind = next((k for k in HASHES if hashes.get(k)), None) or min(hashes)
    return {kind.strip("'"): hashes[kind]}


def _process_id(process: dict, observation: dict | None) -> object:
    """What tells a process from others: an extension's own id, or its number, host and time together."""
    for extension in process.get("extensions", {}).values():
        found = next((extension[k] for k in PROCESS_IDS if extension.get(k)), None)
        if found:
            return found
    if not observation or not process.get("pid"):
        return None
    assets = (o for o in observation.get("objects", {}).values() if o.get("type") == "x-oca-asset")
    host = next((a[k] for a in assets for k in ("host_id", "hostname") if k in a), None)
    return f"{process['pid']}_{host}_{observation['last_observed']}" if host else None


def make_id(sco: dict, observation: dict | None = None, escape_slash: bool = True) -> str:
    """type--uuid: version 5 over the contributing properties as compact JSON with sorted keys, random if there are none.

    observation: that of a 2.0 object, in which references are numbers; what they refer to counts by its own id.
    escape_slash: whether the JSON text has `\\/` for a slash."""
    kind, parts = sco["type"], {}
    for prop in CONTRIBUTING.get(kind, ()):
        if prop == "hashes":
            chosen = _hash(sco.get("hashes"))
            if chosen:
                parts[prop] = chosen
        elif prop in sco:
            if prop.endswith("_ref") and observation:
                target = observation["objects"].get(sco[prop])
                if target:
                    parts[prop] = make_id(target, escape_slash=escape_slash)
            else:
                parts[prop] = sco[prop]
    if kind == "process" and "x_unique_id" not in parts:
        unique = _process_id(sco, observation)
        if unique:
            parts["x_unique_id"] = unique
    if not parts:
        return f"{kind}--{uuid.uuid4()}"
    name = json.dumps(parts, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return f"{kind}--{uuid.uuid5(NAMESPACE, name.replace('/', chr(92) + '/') if escape_slash else name)}"
