"""python -m orrery STEP CONFIG"""

import sys

from orrery.steps import main

if __name__ == "__main__":
    main(*sys.argv[1:3])
