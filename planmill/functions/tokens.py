"""Token text of plan parts, as SQL expression text over nested plan columns."""

NO_TOKENS = "cast(array() as array<string>)"


def tok(kind, value):
    return f"concat('<{kind}:', cast({value} as string), '>')"


def rounded(value):
    """Half-to-even rounding to int, as every coordinate token uses."""
    return f"cast(rint({value}) as int)"


def coord_tokens(coords):
    return (
        f"transform({coords}, (v, i) -> concat(if(i % 2 = 0, '<X:', '<Y:'), cast(v as string), '>'))"
    )


def place_tokens(door):
    return f"array({tok('X', rounded(door + '.x'))}, {tok('Y', rounded(door + '.y'))})"


def size_tokens(door):
    return f"array({tok('X', rounded(door + '.w'))}, {tok('Y', rounded(door + '.h'))})"


def front_door_tokens(front, drop_block="false", drop_coords="false"):
    """Four shapes: left out, shell only, no door, full."""
    return (
        f"case when {drop_block} then {NO_TOKENS} "
        f"when {drop_coords} then array('<FRONT_DOOR>', '<END_DOOR>') "
        f"when size({front}) = 0 then array('<FRONT_DOOR>', '<NO_DOOR>', '<END_DOOR>') "
        f"else concat(array('<FRONT_DOOR>'), {place_tokens(front + '[0]')}, array('<SEP_DOOR>'), "
        f"{size_tokens(front + '[0]')}, array('<END_DOOR>')) end"
    )


def room_tokens(room, with_rid="true", drop_type="false", drop_coords="false", coords=None):
    coords = coords or f"{room}.coords"
    return (
        f"concat(array('<ROOM>'), if({with_rid}, array({tok('RID', room + '.rid')}), {NO_TOKENS}), "
        f"if({drop_type}, {NO_TOKENS}, array({tok('TYPE', room + '.type')})), "
        f"if({drop_coords}, {NO_TOKENS}, {coord_tokens(coords)}), array('<END_ROOM>'))"
    )


def door_list_tokens(doors, mode="cast(null as string)"):
    """`mode` is null, 'position', 'orientation' or 'all' and leaves out place, size or both."""
    return (
        f"if(size({doors}) = 0, array('<NO_DOOR>'), flatten(transform({doors}, d -> concat("
        f"array('<DOOR>'), if(coalesce({mode}, '') in ('position', 'all'), {NO_TOKENS}, {place_tokens('d')}), "
        f"array('<SEP_DOOR>'), if(coalesce({mode}, '') in ('orientation', 'all'), {NO_TOKENS}, {size_tokens('d')}), "
        f"array('<END_DOOR>')))))"
    )


def edge_tokens(edge, pair_mode="cast(null as string)", kept="cast(null as int)", door_mode="cast(null as string)"):
    """`pair_mode` is null (both ends), 'one' (only `kept`) or 'both' (no end)."""
    return (
        f"concat(array('<EDGE>'), case when {pair_mode} = 'both' then {NO_TOKENS} "
        f"when {pair_mode} = 'one' then array({tok('RID', kept)}) "
        f"else transform({edge}.pair, r -> {tok('RID', 'r')}) end, "
        f"{door_list_tokens(edge + '.door', door_mode)}, array('<END_EDGE>'))"
    )


def relation_tokens(rel):
    return (
        f"array('<SP>', {tok('RID', rel + '.rid_a')}, {tok('RID', rel + '.rid_b')}, "
        f"{tok('REL', rel + '.direction')}, '<END_SP>')"
    )


def number_value(token, kind):
    """Integer inside <KIND:n>, null for any other token."""
    return (
        f"cast(nullif(regexp_extract({token}, '^<{kind}:([0-9]+)>$', 1), '') as int)"
    )


def word_value(token, kind):
    """Text inside <KIND:text>, null for any other token."""
    return f"nullif(regexp_extract({token}, '^<{kind}:(.+)>$', 1), '')"
