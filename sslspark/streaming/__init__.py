from sslspark.streaming.stream import *  # noqa: F401,F403
