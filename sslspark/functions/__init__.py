from sslspark.functions.arrays import *  # noqa: F401,F403
from sslspark.functions.keys import *  # noqa: F401,F403
