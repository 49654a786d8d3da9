"""``python -m moodspark``: run the stages."""

import sys

from moodspark.plans.stages import main

sys.exit(main())
