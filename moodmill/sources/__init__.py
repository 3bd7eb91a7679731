from moodmill.sources.readers import *  # noqa: F401,F403
from moodmill.sources.sinks import *  # noqa: F401,F403
