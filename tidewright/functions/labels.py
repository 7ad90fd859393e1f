"""Fixed label sets of the five home-activity schemes and helpers over them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names of each scheme; the position in the list is the class number.
SCHEMES = {
    "aruba": [
        "Bed_To_Toilet", "Eat", "Housekeeping", "Leave_Home", "Meal_Preparation", "Other", "Relax", "Sleeping", "Work",
    ],
    "milan": [
        "Bed_To_Toilet", "Chores", "Dining_Rm_Activity", "Guest_Bathroom", "Kitchen_Activity", "Leave_Home",
        "Master_Bathroom", "Master_Bedroom_Activity", "Meditate", "Other", "Read", "Sleep",
    ],
    "cairo": [
        "Bed_To_Toilet", "Breakfast", "Dinner", "Leave_Home", "Lunch", "Night_Wandering", "Other", "Sleep",
        "Take_Meds", "Wake", "Work_in_Office",
    ],
    "kyoto7": [
        "other", "clean", "meal_preparation", "bed_to_toilet", "personal_hygiene", "sleep", "work", "study",
        "wash_bathtub", "watch_TV",
    ],
    "orange": [
        "Other", "Bathroom|Cleaning", "Bathroom|Showering", "Bathroom|Using_the_sink", "Bathroom|Using_the_toilet",
        "Bedroom|Cleaning", "Bedroom|Dressing", "Bedroom|Napping", "Bedroom|Reading", "Entrance|Entering",
        "Entrance|Leaving", "Kitchen|Cleaning", "Kitchen|Cooking", "Kitchen|Preparing", "Kitchen|Washing_the_dishes",
        "Living_room|Cleaning", "Living_room|Computing", "Living_room|Eating", "Living_room|Watching_TV",
        "Office|Cleaning", "Office|Computing", "Office|Watching_TV", "Staircase|Going_down", "Staircase|Going_up",
        "Toilet|Using_the_toilet",
    ],
}

# Rooms a block or an object may lie in.
ROOMS = ["bedroom", "kitchen", "bathroom", "livingroom"]

# Allowed answers when a label is chosen from a closed set, and the fallback.
CHOICES = {
    "place": (["at home", "outside"], "outside"),
    "room": (ROOMS, "bedroom"),
    "aruba": (
        ["other", "bed_to_toilet", "eat", "enter_Home", "housekeeping", "leave_home", "meal_preparation", "relax",
         "resperate", "sleeping", "wash_dishes", "work"],
        "other",
    ),
    "milan": (
        ["other", "bed_to_toilet", "chores", "desk_Activity", "dining_rm_activity", "evening_meds", "guest_bathroom",
         "kitchen_activity", "leave_home", "master_bathroom", "master_bedroom_activity", "meditate", "morning_meds",
         "read", "sleep", "watch_TV"],
        "other",
    ),
}


def class_id(label, scheme: str) -> Column:
    """Class number of a label, ignoring case; -1 when the scheme does not know it."""
    names = SCHEMES[scheme]
    known = F.array(*[F.lit(n.lower()) for n in names])
    place = F.array_position(known, F.lower(F.trim(F.col(label) if isinstance(label, str) else label)))
    return F.when(place > 0, place - 1).otherwise(-1).cast("int")


def choose(response, choice: str) -> Column:
    """A free answer mapped to its closed set; spelling is compared without case and blanks."""
    allowed, fallback = CHOICES[choice]
    key = F.regexp_replace(F.lower(F.trim(F.col(response))), " ", "")
    out = F.lit(fallback)
    for label in allowed:
        out = F.when(key == label.lower().replace(" ", ""), F.lit(label)).otherwise(out)
    return out
