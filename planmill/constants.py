"""Fixed values of the data model: vocabularies, codes, thresholds and presets."""

# Raster code -> raw room name.
CODE_NAMES = {
    0: "livingroom",
    1: "masterroom",
    2: "kitchen",
    3: "bathroom",
    4: "diningroom",
    5: "childroom",
    6: "studyroom",
    7: "secondroom",
    8: "guestroom",
    9: "balcony",
    10: "entrance",
    11: "storage",
    12: "walkin",
}

# Raw room name -> merged room name.
MERGED_NAMES = {
    "masterroom": "bedroom",
    "childroom": "bedroom",
    "secondroom": "bedroom",
    "guestroom": "bedroom",
    "diningroom": "livingroom",
    "walkin": "storage",
}

# Raster codes that are not rooms.
CODE_EXTERNAL = 13
CODE_WALL = 14
CODE_FRONT_DOOR = 15
CODE_INTERIOR_DOOR = 17

# Final room types (alphabetical) and the eight directions (clockwise from east).
ROOM_TYPES = [
    "balcony", "bathroom", "bedroom", "entrance",
    "kitchen", "livingroom", "storage", "studyroom",
]
OUTLINE = "outline"
DIRECTIONS = [
    "right", "right-below", "below", "left-below",
    "left", "left-above", "above", "right-above",
]

# Structure tokens in id order (the pad token is a category of its own).
PAD_TOKEN = "<PAD>"
STRUCTURE_TOKENS = [
    "<INPUT>", "<END_INPUT>", "<OUTPUT>", "<END_OUTPUT>",
    "<ROOM>", "<END_ROOM>",
    "<EDGE>", "<END_EDGE>", "<DOOR>", "<SEP_DOOR>", "<END_DOOR>", "<NO_DOOR>",
    "<FRONT_DOOR>", "<DOOR_H>", "<DOOR_V>",
    "<SP>", "<END_SP>",
    "<ROOM_SUMMARY>", "<END_ROOM_SUMMARY>", "<TOTAL>", "<COUNT>",
]

# Limits of the token vocabulary and of the raster grid.
MAX_COORD = 255
MAX_RID = 15

# Extraction thresholds.
MIN_ROOM_AREA = 30
MIN_DOOR_PIXELS = 5
DOOR_DILATION = 5
MIN_DOOR_BALANCE = 0.15
VALLEY_RATIO = 0.6
MAX_DOOR_DEPTH = 8

# Scoring thresholds.
RIGHT_ANGLE_TOL = 1e-3
DOOR_REACH = 20.0
ADVANTAGE_EPS = 1e-8

# Chat prompt and default dataset settings.
SYSTEM_PROMPT = (
    "You are a floor plan generator. Given room conditions, "
    "generate complete floorplan coordinates."
)
MAX_LENGTH = 4096
SHARD_RECORDS = 10_000
VAL_RATIO = 0.001
TEST_RATIO = 0.005
