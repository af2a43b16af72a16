"""What a fusion does, worked out base by base for one event, to hold the engine's results against.

Every base of the fused pre-mRNA is a cell: its letter, the slot of the partner that it
comes from, and its number in that partner's CDS, or None. Splicing drops cells; all
statuses follow from the cells that are left.
"""

import itertools
from decimal import ROUND_HALF_EVEN, Decimal

STOPS = ("TAA", "TAG", "TGA")
STARTS = ["native_start_retained", "alternative_start_found", "alternative_start_not_found", "native_start_lost"]
READS = ["preserved", "frame_disrupted", "translation_start_disrupted", "translation_start_excluded", "premature_termination_disrupted", "premature_termination_excluded"]
REPORTED = {"family", "domain", "homologous_superfamily", "binding_site", "active_site", "conserved_site", "motif"}


def joined(found, order):
    return "/".join(x for x in order if x in found) or None


def side_of(slot, model, position, terminus):
    """Cells and sites of a retained part; a site is (index of its base, type, intact)."""
    forward, first, last = model["strand"] == 1, model["transcript_genomic_start"], model["transcript_genomic_end"]
    cut = position - first if forward else last - position
    places = range(cut + 1) if terminus == "N" else range(cut, len(model["premrna_sequence"]))
    number = {p - 1: b["cds_start"] + p - b["premrna_start"] for b in model["cds_blocks"] for p in range(b["premrna_start"], b["premrna_end"] + 1)}
    cells = [(model["premrna_sequence"][p], slot, number.get(p)) for p in places]
    sites = [(s["premrna_position"] - 1 - places[0], s["type"], not s["disruption_start"] <= position <= s["disruption_end"]) for s in model["splice_sites"] if s["premrna_position"] - 1 in places]
    return cells, sites


def choices(sites):
    """One site of each run of intact ones, in all ways."""
    runs = [(kind, [s[0] for s in run]) for kind, run in itertools.groupby((s for s in sorted(sites, key=lambda s: s[0]) if s[2]), key=lambda s: s[1])]
    if runs and runs[0][0] == "acceptor":
        del runs[0]
    if runs and runs[-1][0] == "donor":
        del runs[-1]
    return itertools.product(*(places for _, places in runs))


def product_of(cells, pattern):
    gone = {i for donor, acceptor in zip(pattern[::2], pattern[1::2], strict=True) for i in range(donor + 1, acceptor)}
    return [c for i, c in enumerate(cells) if i not in gone]


def translated(cells):
    """(start, its status and slot, first stop, whether the frame is kept, whether source CDS is read); places count from 0."""
    bases = "".join(c[0] for c in cells)
    native = [i for i, c in enumerate(cells) if c[2] == 1 and bases[i : i + 3] == "ATG"]
    coding = [(i, c[2]) for i, c in enumerate(cells) if c[2] is not None]
    start, slot = None, None
    if native:
        start, status, slot = native[0], "native_start_retained", cells[native[0]][1]
    elif not coding:
        status = "native_start_lost"
    else:
        start = bases.find("ATG") if "ATG" in bases else None
        status = "alternative_start_not_found" if start is None else "alternative_start_found"
    read = [] if start is None else [(i, n) for i, n in coding if i >= start]
    kept = bool(read) and all((i - start) % 3 == (n - 1) % 3 for i, n in read)
    stop = None if start is None else next((i for i in range(start, len(bases) - 2, 3) if bases[i : i + 3] in STOPS), None)
    return start, status, slot, stop, kept, bool(read)


def outcome(wanted, cells, slot, start, status, stop):
    """(spliced, translation) of the CDS bases wanted of a slot in one product."""
    at = {c[2]: i for i, c in enumerate(cells) if c[1] == slot and c[2] in wanted}
    if len(at) < len(wanted):
        return "lost", None
    if start is None:
        return "preserved", "translation_start_excluded" if status == "alternative_start_not_found" else "frame_disrupted"
    read = sorted((n, i) for n, i in at.items() if i >= start)
    if not read:
        return "preserved", "translation_start_excluded"
    if any((n + 1, i + 1) != later for (n, i), later in itertools.pairwise(read)) or (read[0][1] - start) % 3 != (read[0][0] - 1) % 3:
        return "preserved", "frame_disrupted"
    if stop is not None and stop <= read[0][1]:
        return "preserved", "premature_termination_excluded"
    if stop is not None and stop <= read[-1][1]:
        return "preserved", "premature_termination_disrupted"
    return "preserved", "translation_start_disrupted" if start > at[min(at)] else "preserved"


def annotated(event, models):
    """{frame_status, translation_start, domains: {(transcript, entry or feature id, start, end): (breakpoint status, percent, splicing, translation)}} of an event that has no error."""
    parts = []
    for slot in (1, 2):
        name = event[f"transcript{slot}_id"]
        if name:
            terminus = event[f"gene{slot}_terminus"]
            model = models[name.split(".")[0]] | {"asked": name}
            parts.append((terminus != "N", slot, model, *side_of(slot, model, int(event[f"breakpoint{slot}"].split(":")[1]), terminus)))
    parts.sort(key=lambda p: p[0])
    cells, sites = [], []
    for i, (_, _, _, own, spots) in enumerate(parts):
        if i:
            cells = cells + [(b, 0, None) for b in (event["inserted_sequence"] or "").upper()]
        sites += [(len(cells) + at, kind, intact) for at, kind, intact in spots]
        cells = cells + own
    products = [product_of(cells, p) for p in choices(sites)]
    read = [translated(p) for p in products]
    names = {slot: model["asked"] for _, slot, model, _, _ in parts}
    starts = {}
    for _, status, slot, *_ in read:
        starts.setdefault(names[slot] if slot else names[parts[0][1]], set()).add(status)
    frames = {"in_frame" if kept else "out_of_frame" for *_, kept, _ in read}
    told = len(parts) == 2 or any(r[-1] for r in read)
    found = {}
    for _, slot, model, own, _ in sorted(parts, key=lambda p: p[1]):
        here = {c[2] for c in own} - {None}
        for f in model["protein_features"] or []:
            whole = set(range(f["cds_start"], f["cds_end"] + 1))
            left = whole & here
            group = found.setdefault((model["asked"], f["interpro_id"] or f["feature_id"], f["start"], f["end"], f["feature_type"] or f["interpro_entry_type"]), [set(), Decimal(0), set(), set()])
            group[0].add("excluded" if not left else "included" if left == whole else "disrupted")
            group[1] = max(group[1], (Decimal(100 * len(left)) / len(whole)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
            if left:
                wanted = set(range(min(left), max(left) + 1)) if here else left
                for cells_of, (start, status, _, stop, *_) in zip(products, read, strict=True):
                    spliced, translation = outcome(wanted, cells_of, slot, start, status, stop)
                    group[2].add(spliced)
                    group[3].add(translation)
    domains = {k[:4]: (joined(v[0], ["included", "disrupted", "excluded"]), float(v[1]), joined(v[2], ["preserved", "lost"]), joined(v[3], READS)) for k, v in found.items() if k[4] in REPORTED}
    return {
        "frame_status": (frames.pop() if len(frames) == 1 else "in_frame/out_of_frame") if told else None,
        "translation_start": {k: joined(v, STARTS) for k, v in starts.items()},
        "domains": domains,
    }
