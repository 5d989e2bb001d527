"""Small synthetic bundles."""


def identity(n=1):
    return {"type": "identity", "id": f"identity--{n}", "identity_class": "system", "name": f"sensor {n}", "created": "2020-01-01T00:00:00.000Z", "modified": "2020-01-01T00:00:00.000Z"}


def observation(n, objects, minute=0, count=1):
    at = f"2020-06-30T19:{minute:02d}:00.000Z"
    return {"type": "observed-data", "id": f"observed-data--{n}", "created_by_ref": "identity--1", "created": at, "modified": at, "first_observed": at, "last_observed": at.replace(":00.000Z", ":30.000Z"), "number_observed": count, "objects": objects}


def traffic(src, dst, port, bytes_=100):
    kind = "ipv6-addr" if ":" in src else "ipv4-addr"
    return {
        "0": {"type": kind, "value": src},
        "1": {"type": "ipv6-addr" if ":" in dst else "ipv4-addr", "value": dst},
        "2": {"type": "network-traffic", "src_ref": "0", "dst_ref": "1", "src_port": 1024 + port, "dst_port": port, "protocols": ["ipv4", "tcp"], "src_byte_count": bytes_},
        "3": {"type": "user-account", "user_id": f"user{port % 3}", "account_login": f"login{port % 3}"},
    }


def bundle(objects):
    return {"type": "bundle", "id": "bundle--1", "spec_version": "2.0", "objects": [identity(), *objects]}


def connections(n=10, mixed=False):
    """n observations: sources 192.168.0.1 to .5, destinations 10.0.0.1 and .2, ports 20 to 20 + n."""
    out = []
    for i in range(n):
        src, dst = f"192.168.0.{1 + i % 5}", f"10.0.0.{1 + i % 2}"
        if mixed and i % 5 == 4:
            src, dst = f"fe80::{i}", "fe80::ff"
        out.append(observation(i, traffic(src, dst, 20 + i), minute=i))
    return bundle(out)
