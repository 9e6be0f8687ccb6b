import sys

from ticketloom.cli import main

sys.exit(main())
