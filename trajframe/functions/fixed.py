"""Fixed values.

Everything in this module is a value that must be exactly what the original
data pipeline used, otherwise the produced text and ids differ.  They are
listed plainly, in their natural order.  Logic lives elsewhere.
"""

# --- fixed values: task name -> real task id (30 tasks, in this order) ------
TASK_TABLE = [
    ("boil", "1-1"),
    ("melt", "1-2"),
    ("freeze", "1-3"),
    ("change-the-state-of-matter-of", "1-4"),
    ("use-thermometer", "2-1"),
    ("measure-melting-point-known-substance", "2-2"),
    ("measure-melting-point-unknown-substance", "2-3"),
    ("power-component", "3-1"),
    ("power-component-renewable-vs-nonrenewable-energy", "3-2"),
    ("test-conductivity", "3-3"),
    ("test-conductivity-of-unknown-substances", "3-4"),
    ("find-living-thing", "4-1"),
    ("find-non-living-thing", "4-2"),
    ("find-plant", "4-3"),
    ("find-animal", "4-4"),
    ("grow-plant", "5-1"),
    ("grow-fruit", "5-2"),
    ("chemistry-mix", "6-1"),
    ("chemistry-mix-paint-secondary-color", "6-2"),
    ("chemistry-mix-paint-tertiary-color", "6-3"),
    ("lifespan-longest-lived", "7-1"),
    ("lifespan-shortest-lived", "7-2"),
    ("lifespan-longest-lived-then-shortest-lived", "7-3"),
    ("identify-life-stages-1", "8-1"),
    ("identify-life-stages-2", "8-2"),
    ("inclined-plane-determine-angle", "9-1"),
    ("inclined-plane-friction-named-surfaces", "9-2"),
    ("inclined-plane-friction-unnamed-surfaces", "9-3"),
    ("mendellian-genetics-known-plant", "10-1"),
    ("mendellian-genetics-unknown-plant", "10-2"),
]
# spelling fix applied to a task name before the lookup
TASK_NAME_FIX = ("mendelian", "mendellian")

# --- fixed values: rooms of the environment, in this order ------------------
ROOMS = [
    "hallway",
    "greenhouse",
    "green house",
    "kitchen",
    "bathroom",
    "outside",
    "workshop",
    "art studio",
    "foundry",
    "bedroom",
    "living room",
]

# --- fixed values: history sentinel and markers ------------------------------
SENTINEL_ACTION = "look around"
SENTINEL_OBSERVATION = "N/A"
FINAL_SUBGOAL = "complete_task()"
MARKER_ACTION = "end subgoal"
MARKER_OBSERVATION = "the current subgoal is done."
NOISE_ACTION = "look around"
NOISE_PREFIX = "close door"
FAILED_OBSERVATION = "No known action matches that input."
FAILED_MARKERS = ["can't", "not", "doesn't"]
REPEAT_LINE = "Repeat the above action for {} times."

# --- fixed values: text clean-up ---------------------------------------------
# sanitize: separators first, then these phrase replacements, in this order
SANITIZE_SEPARATORS = [("\n\t", " | "), ("\n", " | "), ("\t", " | ")]
SANITIZE_PHRASES = [
    ("green house", "greenhouse"),
    ("activate bee hive", "open bee hive"),
    ("seed peach tree", "peach seed"),
    ("orange tree seed", "orange seed"),
]
# removed from every composed input
DROPPED_PHRASES = ["(that is open)", "(containing nothing)"]

# --- fixed values: action -> formal action (first match wins) ---------------
# (pattern, format, number of arguments).  Zero-argument rules compare the
# stripped text for equality; the others are regex searches.
FORMALIZE_RULES = [
    ("0", "CHOOSE(0)", 0),
    ("1", "CHOOSE(1)", 0),
    ("look around", "SEE()", 0),
    ("wait", "WAIT()", 0),
    ("wait1", "WAIT()", 0),
    (r"^focus on (.+)", "FOCUS({})", 1),
    (r"^look at (.+)", "LOOK({})", 1),
    (r"^read (.+)", "READ({})", 1),
    (r"^pick up (.+)", "PICK({})", 1),
    (r"^open door to (.+)", "OPEN_DOOR({})", 1),
    (r"^close door to (.+)", "CLOSE_DOOR({})", 1),
    (r"^open (.+)", "OPEN({})", 1),
    (r"^close (.+)", "CLOSE({})", 1),
    (r"^activate (.+)", "ACTIVATE({})", 1),
    (r"^deactivate (.+)", "DEACTIVATE({})", 1),
    (r"^go to (.+)", "GO({})", 1),
    (r"^teleport to (.+)", "TELEPORT({})", 1),
    (r"^examine (.+)", "EXAMINE({})", 1),
    (r"^connect (.+) to (.+)", "CONNECT({}, {})", 2),
    (r"^move (.+) to (.+)", "MOVE({}, {})", 2),
    (r"^use (.+) on (.+)", "USE({}, {})", 2),
    (r"^pour (.+) into (.+)", "POUR({}, {})", 2),
    (r"^pour (.+) in (.+)", "POUR({}, {})", 2),
    (r"^dunk (.+) into (.+)", "DUNK({}, {})", 2),
    (r"^mix (.+)", "MIX({})", 1),
    (r"^drop (.+) in (.+)", "DROP({}, {})", 2),
    (r"^drop (.+)", "DROP({})", 1),
    ("end subgoal", "END_SG()", 0),
]

# --- fixed values: formal action -> action (first match wins) ---------------
RECOVER_RULES = [
    ("CHOOSE(0)", "0", 0),
    ("CHOOSE(1)", "1", 0),
    ("SEE()", "look around", 0),
    ("WAIT()", "wait", 0),
    (r"^FOCUS\((.+)\)", "focus on {}", 1),
    (r"^WAIT\((.+)\)", "wait {}", 1),
    (r"^LOOK\((.+)\)", "look at {}", 1),
    (r"^READ\((.+)\)", "read {}", 1),
    (r"^PICK\((.+)\)", "pick up {}", 1),
    (r"^PICKUP\((.+)\)", "pick up {}", 1),
    (r"^PICK_UP\((.+)\)", "pick up {}", 1),
    (r"^OPEN_DOOR\((.+)\)", "open door to {}", 1),
    (r"^CLOSE_DOOR\((.+)\)", "close door to {}", 1),
    (r"^OPEN\((.+)\)", "open {}", 1),
    (r"^CLOSE\((.+)\)", "close {}", 1),
    (r"^ACTIVATE\((.+)\)", "activate {}", 1),
    (r"^DEACTIVATE\((.+)\)", "deactivate {}", 1),
    (r"^TURN_ON\((.+)\)", "activate {}", 1),
    (r"^TURN_OFF\((.+)\)", "deactivate {}", 1),
    (r"^GO\((.+)\)", "go to {}", 1),
    (r"^TELEPORT\((.+)\)", "teleport to {}", 1),
    (r"^EXAMINE\((.+)\)", "examine {}", 1),
    (r"^OBSERVE\((.+)\)", "examine {}", 1),
    (r"^CONNECT\((.+), (.+)\)", "connect {} to {}", 2),
    (r"^MOVE\((.+), (.+)\)", "move {} to {}", 2),
    (r"^PLACE\((.+), (.+)\)", "move {} to {}", 2),
    (r"^USE\((.+), (.+)\)", "use {} on {}", 2),
    (r"^POUR\((.+), (.+)\)", "pour {} into {}", 2),
    (r"^DUNK\((.+), (.+)\)", "dunk {} into {}", 2),
    (r"^MIX\((.+)\)", "mix {}", 1),
    (r"^DROP\((.+), (.+)\)", "drop {} in {}", 2),
    (r"^DROP\((.+)\)", "drop {}", 1),
]

# --- fixed values: candidate filtering ---------------------------------------
# task ids exempt from the task-overlap filter, by action kind
FOCUS_EXEMPT_TASKS = [5, 6, 7, 8, 17, 18, 19, 20]
EXAMINE_EXEMPT_TASKS = [14, 15, 16]
INVALID_FOCUS_EXTRA = ["agent", "air"]
FOCUS_STOPWORDS = ["focus", "on", "in", "to"]

# --- fixed values: down-sampling by real task id prefix ----------------------
DOWNSAMPLE_RULES = [("9-", 50), ("10-", 50), ("3-3", 100)]

# --- fixed values: stop rules of the interactive loop ------------------------
LOOP_WINDOW = 10
STALL_WINDOW = 50
OBJECT_LIMIT_OFFLINE = 25
OBJECT_LIMIT_ONLINE = 20

# Paint-mixing tasks and the container their first prediction names (fixed values).
PAINT_CONTAINERS = {
    "chemistry-mix-paint-tertiary-color": "bowl",
    "chemistry-mix-paint-secondary-color": "jug",
}

# --- fixed values: lines of the agent's prompts that carry a variable part ----
PROMPT_LINES = {
    "example_next": "Example task 1: ",
    "example_plan": "Example task: ",
    "task_next": "In a new science experiment that is similar to the above two, ",
    "task_plan": "In a new science experiment that is similar to the above one, ",
    "history": "My previous {} actions and observations are as follows:",
    "observations": "To complete this task, I have done some actions and the observations are listed here:",
    "focused": "Importantly, I have FOCUS on these things already: ",
    "not_focused": "Importantly, I have FOCUS on nothing yet.",
    "messages": "There are some error messages about my previous actions:",
    "advice": "I asked my teacher for advice and the teacher told me these advice:",
    "environment": "In current environment: ",
    "visited": "In some previously visited locations:",
    "here": "* Current location *: ",
    "instinct": "My instinct tells me that it might be reasonable to {} now but I'm not so sure.",
    "types": "The ONLY allowed action types are:",
    "targets_next": "Important! You can only use FOCUS actions on these items: ",
    "targets_plan": "Remember that it is ONLY possible focus on these items: ",
}

# --- fixed values: the candidate prompt ---------------------------------------
SELECT_INTRO = "Let's play a text game."
SELECT_LIST = "There are some action candidates as follows:"
SELECT_ASK = ("Please consider the objects in the room and inventory and my goal. Think carefully, and then select the "
              "best replacement from the list. If no one in the list is a good replacement, return 'none'.")
