"""Steps, by what they do to the features of a frame."""

from wearline.operators.arithmetic import *  # noqa: F403
from wearline.operators.encoding import *  # noqa: F403
from wearline.operators.imputing import *  # noqa: F403
from wearline.operators.outliers import *  # noqa: F403
from wearline.operators.resampling import *  # noqa: F403
from wearline.operators.rolling import *  # noqa: F403
from wearline.operators.scaling import *  # noqa: F403
from wearline.operators.selection import *  # noqa: F403
from wearline.operators.signals import *  # noqa: F403
from wearline.operators.splitting import *  # noqa: F403
