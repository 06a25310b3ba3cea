"""The rule program over Python sets, written from the rules, for comparison."""


def derive(rows: dict) -> dict[str, set]:
    deny = {r[:3] for r in rows.get("firewallDeny", ()) if len(r) == 3 or r[3] == "deny"}
    access = {tuple(r) for r in rows.get("hacl", ())} - deny
    held = {tuple(r) for r in rows.get("attackerLocated", ())}
    while True:
        new = {(a, d, p) for a, s, _ in held for s2, d, v in access if s2 == s for h, _, v2, p in rows.get("vulExists", ()) if (h, v2) == (d, v)}
        new |= {(a, h, p) for a, h, q in held if q != "root" for h2, _, p in rows.get("localVulExists", ()) if h2 == h}
        if new <= held:
            break
        held |= new
    owned = {(a, h) for a, h, p in held if p == "root"}
    return {"effectiveAccess": access, "execCode": held, "ownsMachine": owned, "goalReached": {tuple(g) for g in rows.get("attackGoal", ())} & owned}


def state(facts) -> dict[str, set]:
    from breachline.plans.facts import DERIVED

    return {p: {tuple(r) for r in facts.relation(p).select(*c).collect()} for p, c in DERIVED.items()}
