"""Higher-order building blocks on arrays, as SQL expression text."""


def let(value, name, body):
    """Evaluate `value` once and use it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def components(items, fields, touch):
    """Label the connected parts of an array of structs.

    `items` is SQL text of an array of structs with a `lab` bigint field that orders them; each
    item ends with the smallest label of its part. `fields` lists the other field names and
    `touch(p, r)` gives SQL text telling whether an earlier item p and item r are neighbours.
    """
    def relabelled(var, lab):
        copied = ", ".join(f"'{f}', {var}.{f}" for f in fields)
        return f"named_struct({copied}, 'lab', {lab})"

    hits = f"array_distinct(transform(filter(done, p -> {touch('p', 'r')}), p -> p.lab))"
    low = "least(r.lab, coalesce(array_min(hit), r.lab))"
    merged = (
        f"concat(if(size(hit) < 2, done, transform(done, p -> if(array_contains(hit, p.lab),"
        f" {relabelled('p', 'array_min(hit)')}, p))), array({relabelled('r', low)}))"
    )
    return f"aggregate({items}, slice({items}, 1, 0), (done, r) -> {let(hits, 'hit', merged)})"
