"""Access-control expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docshield import constants as C

LEVELS = C.SENSITIVITY_LEVELS
UNKNOWN_LEVEL = len(LEVELS)  # strict mode: above every clearance


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _levels() -> Column:
    return F.array(*[F.lit(x) for x in LEVELS])


def level_index(cls, strict: bool = C.UNKNOWN_CLASS_STRICT) -> Column:
    """Ordinal of a sensitivity class.  Null counts as PUBLIC; an unknown
    name is 0 in compat mode and above TOP_SECRET (deny) in strict mode."""
    c = _col(cls)
    pos = F.array_position(_levels(), c)
    return (F.when(c.isNull(), F.lit(0))
            .when(pos > 0, (pos - 1).cast("int"))
            .otherwise(F.lit(UNKNOWN_LEVEL if strict else 0)))


def level_name(idx) -> Column:
    return F.element_at(_levels(), (_col(idx) + 1).cast("int"))


def _role_levels() -> Column:
    kv = []
    for role, cls in C.ROLE_CLEARANCE.items():
        kv += [F.lit(role), F.lit(LEVELS.index(cls))]
    return F.create_map(*kv)


def clearance_level(roles) -> Column:
    """R2: highest clearance over known roles; no known role → PUBLIC (0)."""
    m = _role_levels()
    known = F.filter(_col(roles), lambda r: F.map_contains_key(m, r))
    return F.coalesce(F.array_max(F.transform(known, lambda r: F.try_element_at(m, r))), F.lit(0))


def resolve_clearance(roles) -> Column:
    return level_name(clearance_level(roles))


def role_match(acl_roles, user_roles) -> Column:
    """Empty ACL is open; otherwise an exact element must be shared."""
    a = _col(acl_roles)
    return (F.size(a) == 0) | F.coalesce(F.arrays_overlap(a, _col(user_roles)), F.lit(False))


def user_match(acl_users, user_id) -> Column:
    """Empty user ACL or no user id is open; otherwise the id must be listed."""
    a = _col(acl_users)
    u = _col(user_id).cast("string")
    return a.isNull() | (F.size(a) == 0) | u.isNull() | F.array_contains(a, u)


def access_reason(user_roles, chunk_class, acl_roles, user_id=None, acl_users=None,
                  strict: bool = C.UNKNOWN_CLASS_STRICT) -> Column:
    """R3 in order: clearance, role ACL, user ACL; 'ok' when allowed."""
    ul = clearance_level(user_roles)
    cl = level_index(chunk_class, strict)
    r = F.when(cl > ul, F.concat(F.lit("clearance_insufficient: "), level_name(ul), F.lit(" < "),
                                 F.coalesce(_col(chunk_class), F.lit("PUBLIC"))))
    r = r.when(~role_match(acl_roles, user_roles), F.lit("acl_role_mismatch"))
    if acl_users is not None and user_id is not None:
        r = r.when(~user_match(acl_users, user_id), F.lit("acl_user_mismatch"))
    return r.otherwise(F.lit("ok"))


def filter_reason(user_tenant, chunk_tenant, user_roles, chunk_class, acl_roles, user_id=None,
                  acl_users=None, strict: bool = C.UNKNOWN_CLASS_STRICT) -> Column:
    """Cross-tenant is rejected before any role logic, in every mode."""
    ct = F.coalesce(_col(chunk_tenant), F.lit("default"))
    return F.when(ct != _col(user_tenant), F.lit("tenant_boundary")).otherwise(
        access_reason(user_roles, chunk_class, acl_roles, user_id, acl_users, strict))
