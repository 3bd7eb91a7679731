from moodmill.functions.text import *  # noqa: F401,F403
